"""Compaction, summary and retention of tables, decided on metadata as DataFrames.

The bulk work is a read, a filter and one partitioned write for each pass; nothing is
removed before the copy's counts are verified, and dry runs are the default.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PREFIX, TERMINAL
from ..sources.tables import delete_rows, folders_of, read_union, remove, rename
from .ordered import saved, sortable

#: Limits and grace periods.
ROW_CEILING = 2_000_000
QUIET_MS, ABANDONED_MS, SETTLED_MS, SKEW_MS, RECENT_MS = 900_000, 86_400_000, 7 * 86_400_000, 300_000, 86_400_000
MAX_SCANS = 4
#: Bytes of a compacted file, as JSON, about.
FILE_BYTES = 512 << 20
ACTION_TERMINAL = ("COMPLETED_SUCCESSFULLY", "COMPLETED_PARTIALLY", "FAILED", "TIMEOUT", "ABORTED", "CANCELED", "EXPIRED")


def slug(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def shard_suffix(host: str) -> Column:
    """A host's part of a table name: slug of at most 32 characters that starts with a
    letter, and six digits of the name's SHA-1, so that hosts never share one."""
    base = F.substring(slug(host), 1, 32)
    named = F.when(base.rlike("^[a-z]"), base).otherwise(F.concat(F.lit("h_"), base))
    return F.concat(named, F.lit("_"), F.substring(F.sha1(F.col(host).cast("binary")), 1, 6))


def target_name(kind: str, version: int, scan_id: str, prefix: str = PREFIX) -> Column:
    """The name of a scan's compacted table."""
    s = slug(scan_id)
    return F.concat(F.lit(f"{prefix}_{kind}_v{version}_"), F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s))


def parse_names(catalog: DataFrame, prefix: str = PREFIX, name: str = "name") -> DataFrame:
    """kind, version, host, month, scan_target and overwrite of owned names, null for others.

    A month is 20YY01 to 20YY12. scan_target: a compacted scan's table. overwrite: the live
    table of a host, which has no month and is replaced by each scan (matches from v4).
    """
    n = F.col(name)
    head = rf"^{prefix}_(matches|scans)_v(\d+)"
    owned = n.rlike(head + "(_|$)")
    rest = F.regexp_extract(n, head + r"_?(.*)$", 3)
    shard = r"^(.*?_[0-9a-f]{6})(?:_(20\d{2}(?:0[1-9]|1[0-2])))?$"
    is_shard = rest.rlike(shard)
    month = F.nullif(F.regexp_extract(rest, shard, 2), F.lit(""))
    kind = F.regexp_extract(n, head, 1)
    version = F.regexp_extract(n, head, 2).try_cast("int")
    live = owned & is_shard & month.isNull() & (kind == "matches") & (version >= 4)
    return catalog.withColumns({
        "owned": owned,
        "kind": F.when(owned, kind),
        "version": F.when(owned, version),
        "host": F.when(owned & is_shard, F.regexp_extract(rest, shard, 1)),
        "month": F.when(owned & is_shard, month),
        "scan_target": owned & ~is_shard & (rest != ""),
        "overwrite": live,
    })


def parse_shard(catalog: DataFrame, prefix: str = PREFIX, name: str = "name") -> DataFrame:
    """Only per-host shards: targets, foreign names and live tables are left out."""
    return parse_names(catalog, prefix, name).where("owned AND host IS NOT NULL AND NOT overwrite")


def classify(catalog: DataFrame, version: int, prefix: str = PREFIX) -> DataFrame:
    """generation of owned names: current, legacy or newer than the schema version."""
    v = F.col("version")
    return parse_names(catalog, prefix).where("owned").withColumn("generation", F.when(v == version, "current").when(v < version, "legacy").otherwise("newer"))


def scan_stats(rows: DataFrame, shard: str = "shard", ingest: str = "_insert_time") -> DataFrame:
    """Rows, newest endpoint stamp and newest ingest stamp of each scan in each shard."""
    srv = F.max(as_ms(ingest)) if ingest in rows.columns else F.lit(None).cast("bigint")
    return rows.groupBy(shard, "scan_id").agg(F.count("*").alias("rows"), F.max(as_ms("event_timestamp_ms")).alias("newest_endpoint_ms"), srv.alias("newest_ingest_ms"))


def as_ms(col: str | Column) -> Column:
    """Epoch milliseconds of a number, a numeric text (exponents too) or an ISO-8601 text;
    null for truth values and anything else."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    number = F.when(~F.lower(c).isin("true", "false"), c.try_cast("double"))
    stamp = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_millis(c.try_cast("timestamp")))
    return F.coalesce(number.cast("bigint"), stamp)


def newest_ms(endpoint: Column, ingest: Column, now: int) -> Column:
    """The newest plausible stamp. An ingest stamp after now is dropped if there is an
    endpoint stamp; an endpoint stamp after the ingest stamp (that stays) is dropped; five
    minutes of skew are allowed."""
    srv = F.when(endpoint.isNotNull() & (ingest > now + SKEW_MS), F.lit(None)).otherwise(ingest)
    ep = F.when(srv.isNotNull() & (endpoint > srv + SKEW_MS), F.lit(None)).otherwise(endpoint)
    return F.greatest(ep, srv)


def terminal_map(lifecycle: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """terminal of each (scan, host): its latest status or its action's state has ended."""
    newest = lifecycle.groupBy("scan_id", "hostname").agg(F.max_by("status", F.struct("event_timestamp_ms", "status")).alias("status"))
    done = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    if actions is None:
        return newest.select("scan_id", "hostname", done.alias("terminal"))
    acted = actions.groupBy("scan_id", "hostname").agg(F.max(F.upper("state").isin(*ACTION_TERMINAL)).alias("acted"))
    joined = newest.join(acted, ["scan_id", "hostname"], "full_outer")
    return joined.select("scan_id", "hostname", (done | F.coalesce("acted", F.lit(False))).alias("terminal"))


def gate(stats: DataFrame, terminals: DataFrame, now: int) -> DataFrame:
    """reason for each scan, null if it may be compacted: that of the first failing shard.

    stats has scan_id, shard, hostname and the newest stamps. A host that isn't terminal
    passes once its rows are a day old, or its endpoint stamp a week; rows under 15 minutes
    old wait, unless settled.
    """
    rows = stats.join(terminals, ["scan_id", "hostname"], "left")
    newest = newest_ms(F.col("newest_endpoint_ms"), F.col("newest_ingest_ms"), now)
    age = F.lit(now) - newest
    settled = F.coalesce(F.lit(now) - F.col("newest_endpoint_ms") >= SETTLED_MS, F.lit(False))
    abandoned = F.coalesce(age >= ABANDONED_MS, F.lit(False))
    reason = F.when(~F.coalesce("terminal", F.lit(False)) & ~abandoned & ~settled, "host_not_terminal").when(F.coalesce(age < QUIET_MS, F.lit(False)) & ~settled, "within_quiet_period")
    failing = rows.withColumn("__r", reason)
    return failing.groupBy("scan_id").agg(F.min_by("__r", F.when(F.col("__r").isNotNull(), F.col("shard"))).alias("reason"))


def plan(counts: DataFrame, ceiling: int | None = ROW_CEILING) -> DataFrame:
    """state from source_rows and target_rows: row_ceiling_exceeded (never, if that is None),
    verified or count_mismatch."""
    s, t = F.col("source_rows"), F.col("target_rows")
    return counts.withColumn("state", F.when(_above(ceiling), "row_ceiling_exceeded").when((s == t) & (s > 0), "verified").otherwise("count_mismatch"))


def _above(ceiling: int | None) -> Column:
    return F.lit(False) if ceiling is None else F.col("source_rows") > ceiling


def reverify(counts: DataFrame) -> DataFrame:
    """What to do with scans that ran before: write, verified (with partial_cleanup where
    sources are already partly gone) or count_mismatch."""
    s, t = F.col("source_rows"), F.coalesce(F.col("target_rows"), F.lit(0))
    state = F.when(t == 0, "write").when(t == s, "verified").when((t > s) & (s > 0), "verified").otherwise("count_mismatch")
    return counts.withColumn("state", state).withColumn("partial_cleanup", (t > s) & (s > 0))


def coerce(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Exactly the named columns as number, integer, text or bool (true, 1 and yes); absent
    columns are null and others are dropped. A value that isn't of its kind (text that is no
    number, a fraction for an integer) is null there and kept as it was in ``unparsed``, a
    map by column, so that nothing is lost."""

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    def one(name: str, kind: str) -> Column:
        c = text(name)
        if kind == "number":
            return c.try_cast("double")
        if kind == "integer":
            whole = F.coalesce(c.try_cast("decimal(38,18)"), c.try_cast("double").try_cast("decimal(38,18)"))
            return F.when(F.floor(whole) == whole, whole.try_cast("bigint"))
        if kind == "bool":
            return F.when(c.isNotNull(), F.lower(F.trim(c)).isin("true", "1", "yes"))
        return c

    lost = [F.when(text(n).isNotNull() & one(n, k).isNull(), F.struct(F.lit(n).alias("k"), text(n).alias("v"))) for n, k in kinds.items()]
    kept = F.map_from_entries(F.filter(F.array(*lost), lambda x: x.isNotNull()))
    return df.select(*(one(n, k).alias(n) for n, k in kinds.items()), kept.alias("unparsed"))


def droppable(shard_scans: DataFrame, verified: DataFrame) -> DataFrame:
    """Shards all of whose scans are verified, and that aren't live tables."""
    marked = shard_scans.join(verified.select("scan_id").distinct().withColumn("__v", F.lit(True)), "scan_id", "left")
    out = marked.groupBy("shard").agg(F.min(F.coalesce("__v", F.lit(False))).alias("all_verified"))
    live = parse_names(out.withColumnRenamed("shard", "name")).where("all_verified AND NOT overwrite")
    return live.select(F.col("name").alias("shard"))


def group_shards_by_scan(rows: DataFrame, shard: str = "shard") -> DataFrame:
    return rows.groupBy("scan_id", shard).agg(F.count("*").alias("rows"))


@dataclass(frozen=True)
class Compaction:
    """Outcome of a pass. ``scans`` has a row for each scan of it that has rows: scan_id, planned and
    state (verified, why it failed, or write in a dry run). The lists are for passes of a few scans:
    each is collected when it is first asked for."""

    scans: DataFrame
    stopped_early: bool
    dry_run: bool

    @property
    def of_verified(self) -> DataFrame:
        return self.scans.where("state = 'verified'").select("scan_id")

    @cached_property
    def planned(self) -> list[str]:
        return sorted(r["scan_id"] for r in self.scans.where("planned").select("scan_id").collect())

    @cached_property
    def verified(self) -> list[str]:
        return sorted(r["scan_id"] for r in self.of_verified.collect())

    @cached_property
    def failed(self) -> dict[str, str]:
        return {r["scan_id"]: r["state"] for r in self.scans.where("state NOT IN ('verified', 'write')").collect()}


def compact(spark: SparkSession, shards: dict[str, DataFrame], target: str, eligible: DataFrame, max_scans: int | None = MAX_SCANS, dry_run: bool = True, ceiling: int | None = ROW_CEILING, file_bytes: int = FILE_BYTES) -> Compaction:
    """Copy the eligible scans' rows from all shards to ``target``, one partition a pass.

    Rows are dealt to files by what they measure as JSON, which is more than they take as Parquet:
    a scan of b such bytes gets at most b / ``file_bytes`` + 1 files, from however many tasks and
    shards it comes, and a large scan is written by as many tasks. Small scans share files, in
    which rows are in order of the scan. A pass is written aside and appears by one rename.

    A pass takes the first ``max_scans`` by id, or all if that is None, and of these the ones of at
    most ``ceiling`` rows, or of any number. All of them are written by one job and verified by one
    count; a scan that is there with as many rows isn't written again. Scans, counts and states are
    tables that rows are joined with, so a pass may be of any number of scans; in one of all, rows
    are counted by the tasks that read them, so that a large scan fills no task.
    """
    some = saved(eligible.select("scan_id").where("scan_id IS NOT NULL").distinct(), "ids")
    stopped = max_scans is not None and some.count() > max_scans
    if stopped:
        some = saved(some.orderBy("scan_id").limit(max_scans), "ids")
    every = read_union(list(shards.values()))

    def of_pass(rows: DataFrame, *sums: Column) -> DataFrame:
        few = rows if max_scans is None else rows.join(some, "scan_id", "left_semi").select(*rows.columns)
        return few.groupBy("scan_id").agg(*sums).join(some, "scan_id", "left_semi")

    def there() -> DataFrame:
        got = spark.read.schema(every.schema).parquet(target)  # with the ids as text, whatever they look like
        return of_pass(got, F.count("*").alias("target_rows"))

    sources = saved(of_pass(every, F.count("*").alias("source_rows"), F.sum(F.octet_length(F.to_json(F.struct(*every.columns))).cast("bigint")).alias("bytes")), "sources")

    if folders_of(spark, target):
        before = sources.join(there(), "scan_id", "left")
    else:
        before = sources.withColumn("target_rows", F.lit(0).cast("bigint"))
    state = F.when(_above(ceiling), "row_ceiling_exceeded").otherwise(F.col("state"))
    states = saved(reverify(before).select("scan_id", "source_rows", "bytes", state.alias("state")), "states")
    own = states.where("state = 'write'").drop("state")
    outcome = states.select("scan_id", (F.col("state") == "write").alias("planned"), "state")
    files = own.select("scan_id", F.ceil(F.greatest("bytes", F.lit(1)) / file_bytes).alias("__files"), "bytes")
    size, n = files.agg(F.sum("bytes"), F.sum("__files")).first()
    if not dry_run and n:
        tasks = max(-(-size // file_bytes), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = every.join(files.drop("bytes"), "scan_id")
        dealt = dealt.withColumn("__file", F.pmod(F.xxhash64(*sortable(every)), "__files")).repartition(int(tasks), "scan_id", "__file")
        name = uuid.uuid4().hex
        aside = f"{target.rstrip('/')}/_pass-{name}"  # which readers don't see
        dealt.drop("__files", "__file").sortWithinPartitions("scan_id").write.parquet(aside)
        rename(spark, aside, f"{target.rstrip('/')}/pass=p{name}")
        checked = plan(own.join(there(), "scan_id", "left"), ceiling).select("scan_id", F.lit(True).alias("planned"), "state")
        outcome = saved(outcome.where("NOT planned").unionByName(checked), "outcome")
    return Compaction(outcome, stopped, dry_run)


def strip_verified(spark: SparkSession, path: str, verified: list[str] | DataFrame, partition: str = "hostname") -> int:
    """Delete verified scans' rows from a shared match table; lifecycle is never stripped."""
    if isinstance(verified, list):
        verified = saved(spark.createDataFrame([(i,) for i in sorted(set(verified))], "scan_id string"), "ids")
    return delete_rows(spark, path, verified, partition)


def drop_sources(spark: SparkSession, paths: dict[str, str], shard_scans: DataFrame, outcome: Compaction, shared: tuple[str, ...] = ()) -> tuple[list[str], int]:
    """The last step of a pass: remove the shards (``paths`` by name) all of whose scans are
    verified, and the verified scans' rows from ``shared`` match tables. Returns the removed
    shards and the number of rows. A dry run removes nothing."""
    verified = outcome.of_verified
    if outcome.dry_run or verified.isEmpty():
        return [], 0
    gone = sorted(r["shard"] for r in droppable(shard_scans, verified).collect() if r["shard"] in paths)  # some of the given paths
    for name in gone:
        remove(spark, paths[name])
    return gone, sum(strip_verified(spark, p, verified) for p in shared)


def compaction_status(plans: DataFrame, kinds: int) -> DataFrame:
    """A row for each scan: ready only if it is in all its kinds; blocked before pending.
    plans has scan_id, kind, state (ready, pending, blocked) and reason."""
    out = plans.groupBy("scan_id").agg(F.countDistinct("kind").alias("kinds"), F.max(F.when(F.col("state") == "blocked", 2).when(F.col("state") == "pending", 1).otherwise(0)).alias("worst"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return out.select("scan_id", F.when(F.col("worst") == 2, "blocked").when((F.col("worst") == 1) | (F.col("kinds") < kinds), "pending").otherwise("ready").alias("state"), "reasons")


def scan_rule_summary(findings: DataFrame) -> DataFrame:
    """(scan_id, hostname, rule, event_timestamp_ms): the newest stamp of each; current rows
    by their array, older ones by their rule; rows without a scan or rule go; null host is ""."""
    rule = F.explode(F.when(F.col("rules").isNotNull(), F.col("rules.rule")).otherwise(F.array("rule")))
    rows = findings.select("scan_id", F.coalesce("hostname", F.lit("")).alias("hostname"), rule.alias("rule"), "event_timestamp_ms")
    return rows.where("scan_id IS NOT NULL AND scan_id <> '' AND rule IS NOT NULL AND rule <> ''").groupBy("scan_id", "hostname", "rule").agg(F.max("event_timestamp_ms").alias("event_timestamp_ms"))


def summary_plan(scans: DataFrame, now: int, retention_hours: int = 24) -> DataFrame:
    """action from terminal, newest_ms, expected_rows and summary_rows of a scan: wait, skip
    (summarised), fail (another count is there) or write."""
    old = F.coalesce(F.lit(now) - F.col("newest_ms") >= retention_hours * 3_600_000, F.lit(False))
    have = F.coalesce("summary_rows", F.lit(0))
    return scans.withColumn("action", F.when(~(F.col("terminal") | old), "wait").when(have == F.col("expected_rows"), "skip").when(have > 0, "fail").otherwise("write"))


def months_between(month: str | Column, now_year: int, now_month: int) -> Column:
    """Whole months from YYYYMM to now; negative for the future."""
    c = (F.col(month) if isinstance(month, str) else month).cast("string")
    return F.lit(now_year * 12 + now_month) - (F.substring(c, 1, 4).try_cast("int") * 12 + F.substring(c, 5, 2).try_cast("int"))


def has_rotated_sibling(catalog: DataFrame, name: str = "name") -> DataFrame:
    """has_sibling: another table has this name, ``_`` and exactly six digits."""
    stems = catalog.select(F.regexp_extract(name, r"^(.*)_\d{6}$", 1).alias("__stem")).where("__stem <> ''").distinct().withColumn("has_sibling", F.lit(True))
    return catalog.join(stems, catalog[name] == stems["__stem"], "left").drop("__stem").withColumn("has_sibling", F.coalesce("has_sibling", F.lit(False)))


def select_rotated(catalog: DataFrame, months: int, now_year: int, now_month: int, prefix: str = PREFIX) -> DataFrame:
    """selected and the reason for what isn't: only shards of months strictly older than
    ``months`` are; targets, live, unsuffixed, current and future ones never."""
    age = months_between("month", now_year, now_month)
    reason = (
        F.when(~F.col("owned"), "foreign")
        .when(F.col("scan_target"), "scan_target")
        .when(F.col("overwrite"), "overwrite")
        .when(F.col("month").isNull(), "not_rotated")
        .when(age < 0, "future_month")
        .when(age == 0, "current_month")
        .when(age <= months, "within_window")
    )
    out = parse_names(catalog, prefix).withColumn("age_months", age).withColumn("reason", reason)
    return out.withColumn("selected", F.col("reason").isNull())


def filter_recent(selected: DataFrame, now: int, hours: int = 24) -> DataFrame:
    """Of selected tables, those with a row newer than ``hours`` (1 at least) are kept back."""
    fresh = F.coalesce(F.lit(now) - newest_ms(F.col("newest_endpoint_ms"), F.col("newest_ingest_ms"), now) < max(1, hours) * 3_600_000, F.lit(False))
    held = F.col("selected") & fresh
    return selected.withColumn("reason", F.when(held, "recently_written").otherwise(F.col("reason"))).withColumn("selected", F.col("selected") & ~held)


def filter_unconsolidated(selected: DataFrame, shard_scans: DataFrame, target_counts: DataFrame) -> DataFrame:
    """Of selected tables, those with a scan whose compacted copy has another count stay."""
    joined = shard_scans.join(target_counts.select("scan_id", "target_rows"), "scan_id", "left")
    open_ = joined.groupBy(F.col("shard").alias("__s")).agg(F.max(F.coalesce(F.col("target_rows") != F.col("rows"), F.lit(True))).alias("__open"))
    out = selected.join(open_, selected["name"] == open_["__s"], "left").drop("__s")
    held = F.col("selected") & F.coalesce("__open", F.lit(False))
    return out.withColumn("reason", F.when(held, "unconsolidated").otherwise(F.col("reason"))).withColumn("selected", F.col("selected") & ~held).drop("__open")


def select_legacy(catalog: DataFrame, version: int, months: int, now_year: int, now_month: int, prefix: str = PREFIX) -> DataFrame:
    """The retention choice among older schema versions; none at all if a newer one exists."""
    out = select_rotated(catalog, months, now_year, now_month, prefix)
    flag = out.agg(F.max(F.coalesce(F.col("version") > version, F.lit(False))).alias("__newer"))
    rows = out.crossJoin(F.broadcast(flag))  # one row
    reason = F.when(F.coalesce("__newer", F.lit(False)), "newer_schema_exists").when(F.col("version") == version, "current_schema").otherwise(F.col("reason"))
    return rows.withColumn("reason", reason).withColumn("selected", F.col("reason").isNull()).drop("__newer")


def prune(catalog: DataFrame, now: int, now_year: int, now_month: int, months: int | None = None, legacy_version: int | None = None, quiet_hours: int = 24, execute: bool = False, drop=None) -> DataFrame:
    """The tables' verdicts; with ``execute`` the selected are given to ``drop`` by name.

    Nothing is selected without a window or a legacy version; a window under 0 is 0.
    """
    if months is None and legacy_version is None:
        return parse_names(catalog).withColumn("selected", F.lit(False)).withColumn("reason", F.lit("no_window"))
    window = max(0, months or 0)
    chosen = select_legacy(catalog, legacy_version, window, now_year, now_month) if legacy_version is not None else select_rotated(catalog, window, now_year, now_month)
    out = filter_recent(chosen, now, quiet_hours)
    if execute and drop is not None:
        for r in out.where("selected").select("name").toLocalIterator():
            drop(r["name"])
    return out


def inventory(catalog: DataFrame, version: int, now_year: int, now_month: int, prefix: str = PREFIX) -> DataFrame:
    """state and age of every table."""
    named = has_rotated_sibling(parse_names(catalog, prefix))
    state = F.when(~F.col("owned"), "unrecognised").when(F.col("scan_target"), "consolidated").when(F.col("overwrite"), "overwrite").when(F.col("month").isNotNull(), "rotated").when(F.col("has_sibling"), "frozen").otherwise("not_rotated")
    return named.withColumn("state", state).withColumn("age_months", months_between("month", now_year, now_month))


def prune_rows(spark: SparkSession, path: str, cutoff: str, partition: str = "scan_date") -> int:
    """Delete rows of days before ``cutoff`` (YYYYMMDD, in text order)."""
    return delete_rows(spark, path, F.col("scan_date").cast("string") < cutoff, partition)


def stale_scan_ids(rows: DataFrame, host: str, current: str) -> DataFrame:
    return rows.where((F.col("hostname") == host) & (F.col("scan_id") != current)).select("scan_id").distinct()
