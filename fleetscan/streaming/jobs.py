"""The operators on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import resource_alerts
from ..operators.findings import scan
from ..operators.scan import Rule
from ..operators.telemetry import parse_telemetry
from ..schemas import TELEMETRY, TERMINAL, schema
from ..sources.tables import folders_of, remove, written


def ingest_telemetry(spark: SparkSession, source: str, sink: str, checkpoint: str, max_files: int = 1000):
    """Read new NDJSON files, parse them and append Parquet; returns the running query."""
    raw = spark.readStream.schema(schema(TELEMETRY)).option("maxFilesPerTrigger", max_files).json(source)
    return parse_telemetry(raw).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def tumbling(stream: DataFrame, span: str, keys: list[str], aggregates: list, late: str = "10 minutes") -> DataFrame:
    """Aggregates over tumbling windows of event time; rows later than ``late`` are dropped."""
    out = stream.withWatermark("_time", late).groupBy(F.window("_time", span), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("bin"), *out.columns[1:])


def levels(stream: DataFrame, spans: list[str], keys: list[str], sums: dict[str, str], late: str = "10 minutes") -> dict[str, DataFrame]:
    """Sums and counts (``rows``) over windows of each of ``spans``, by span. Each level is made of the
    windows of the one before, so its state is as small as they are; a span is a multiple of
    the one before."""
    span, *coarser = spans
    now = stream.withWatermark("_time", late).groupBy(F.window("_time", span), *keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.count("*").alias("rows"))
    found = {span: now}
    for span in coarser:
        timed = now.withColumn("__at", F.window_time("window"))
        now = timed.groupBy(F.window("__at", span), *keys).agg(*(F.sum(n).alias(n) for n in (*sums, "rows")))
        found[span] = now
    return {s: df.select(F.col("window.start").alias("bin"), *df.columns[1:]) for s, df in found.items()}


def first_findings(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each (scan, host, rule, file); the state is bounded by the watermark."""
    return stream.withWatermark("_time", late).dropDuplicatesWithinWatermark(["scan_id", "hostname", "rule", "path"])


class Forgetting(StatefulProcessor):
    """A value of a key that is forgotten once the key was silent for ``quiet_ms`` of event time."""

    shape = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.shape + ", timer bigint")

    def kept(self) -> tuple | None:
        return tuple(self.value.get())[:-1] if self.value.exists() else None

    def keep(self, value: tuple, last_ms: int) -> None:
        before = self.value.get()[-1] if self.value.exists() else None
        at = max(last_ms + self.quiet_ms, before or 0)
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        self.value.update((*value, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.value.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


#: States that the keys of a stream are dealt to where keys are many and small. A key of its own for
#: each would cost some milliseconds of calls between Python and the state store.
STATES = 256


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``bucket``, the state that a row's key belongs to."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(STATES)).cast("int"))


class Bucket(StatefulProcessor):
    """The values of many keys in one state, as columns; one timer, for the first that is due."""

    shape = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.shape)
        self.timer = handle.getValueState("timer", "at bigint")

    def kept(self) -> list[tuple]:
        """A tuple for each key."""
        return list(zip(*self.value.get(), strict=True)) if self.value.exists() else []

    def keep(self, rows: list[tuple], due: list[int]) -> None:
        if rows:
            self.value.update(tuple(map(list, zip(*rows, strict=True))))
        else:
            self.value.clear()
        before, at = self.timer.get()[0] if self.timer.exists() else None, min(due, default=None)
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def expired(self) -> None:
        """To be called first when the timer expires."""
        self.timer.clear()

    def close(self) -> None:
        pass


def _ms(times: pd.Series) -> pd.Series:
    """Whole milliseconds of stamps, of whatever unit."""
    return times.astype("datetime64[us]").astype("int64") // 1000 if times.dt.tz is None else _ms(times.dt.tz_convert("UTC").dt.tz_localize(None))


class FirstSeen(Bucket):
    """Passes rows whose id isn't among the last ids seen of its scan, host and part, of which it keeps
    between ``most`` / 2 and ``most``, in two generations: where the younger is full, the older
    goes. All are forgotten once there was none for ``quiet_ms`` of event time."""

    shape = "scan array<string>, host array<string>, part array<int>, young array<string>, old array<string>, timer array<bigint>"
    columns = ["scan_id", "hostname", "rule", "path", "seen"]

    def __init__(self, most: int, quiet_ms: int):
        self.half, self.quiet_ms = max(1, most // 2), quiet_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # Ids of 32 signs, one after another.
        kept = {r[:3]: r[3:] for r in self.kept()}
        pdf, new, open_ = pd.concat(list(rows), ignore_index=True).sort_values(["seen", "id"]), [], {}
        for i, (one, at, *group) in enumerate(zip(pdf["id"], _ms(pdf["seen"]), _plain(pdf["scan_id"]), _plain(pdf["hostname"]), pdf["part"].tolist(), strict=True)):
            group = tuple(group)
            if group not in open_:
                before = kept.get(group, ("", "", 0))
                open_[group] = [{x[j : j + 32]: None for j in range(0, len(x), 32)} for x in before[:2]] + [before[2]]
            state = open_[group]
            if one not in state[0] and one not in state[1]:
                new.append(i)
                if len(state[0]) >= self.half:
                    state[:2] = {}, state[0]
                state[0][one] = None
            state[2] = max(state[2], at + self.quiet_ms)
        kept |= {g: ("".join(y), "".join(o), int(t)) for g, (y, o, t) in open_.items()}
        self.keep([(*g, *v) for g, v in kept.items()], [v[2] for v in kept.values()])
        yield pdf.iloc[new][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.expired()
        left = [r for r in self.kept() if r[5] > timerValues.getCurrentWatermarkInMs()]
        self.keep(left, [r[5] for r in left])
        yield pd.DataFrame(columns=self.columns)


def _plain(column: pd.Series) -> list:
    """Values with None for null."""
    return column.astype(object).where(column.notna(), None).tolist()


#: Parts into which a host's findings are dealt, so that one host isn't one state.
SEEN_PARTS = 16


def first_findings_bounded(stream: DataFrame, most: int = 150_000, quiet_ms: int = 3_600_000, late: str = "1 hour", parts: int = SEEN_PARTS) -> DataFrame:
    """The first row (scan_id, hostname, rule, path, _time) of each (scan, host, rule, file), with a
    state of at most ``most`` ids for a scan on a host.

    It keeps at least the last ``most`` / 2 different findings, and forgets a part that was silent
    for ``quiet_ms`` of event time. A finding that was forgotten and comes again is passed again.
    Rows later than ``late`` are dropped. A null counts as a value of its own.
    """
    id_ = F.substring(F.sha2(F.to_json(F.struct("rule", "path")).cast("binary"), 256), 1, 32)
    rows = stream.select("scan_id", "hostname", "rule", "path", F.col("_time").alias("seen"), id_.alias("id")).withWatermark("seen", late)
    parted = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    out = "scan_id string, hostname string, rule string, path string, seen timestamp"
    got = dealt(parted, "scan_id", "hostname", "part").groupBy("bucket").transformWithStateInPandas(FirstSeen(max(2, most // parts), quiet_ms), out, "Append", "EventTime")
    return got.withColumnRenamed("seen", "_time")


class LastKept(Forgetting):
    """Passes a worker's first report, and each that comes ``least`` microseconds or more after the
    last one passed, which is its state."""

    shape, columns = "us bigint", ["hostname", "worker_id", "us"]

    def __init__(self, least: int, quiet_ms: int):
        self.least, self.quiet_ms = least, quiet_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = (self.kept() or (None,))[0]
        pdf, keep = pd.concat(list(rows), ignore_index=True).sort_values("us", kind="stable"), []
        for i, us in enumerate(pdf["us"]):
            if last is None or us - last >= self.least:
                last = int(us)
                keep.append(i)
        self.keep((last,), int(pdf["us"].max()) // 1000)
        yield pdf.iloc[keep][self.columns]


def throttle_stream(reports: DataFrame, interval_secs: float = 30, quiet_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """Reports (hostname, worker_id, _time) throttled as by
    :func:`~fleetscan.operators.telemetry.throttle_reports`, of which this is the same for
    reports that arrive in order of time.

    A micro-batch is put in order of time for each worker. A report that arrives later than one
    that was kept and isn't ``interval_secs`` younger is left out, as are rows later than
    ``late``. A worker that was silent for ``quiet_ms`` of event time begins anew.
    """
    rows = reports.where(F.col("_time").isNotNull()).select("hostname", "worker_id", F.col("_time").alias("seen"), F.unix_micros("_time").alias("us")).withWatermark("seen", late)
    kept = rows.groupBy("hostname", "worker_id").transformWithStateInPandas(LastKept(int(interval_secs * 1_000_000), quiet_ms), "hostname string, worker_id string, us bigint", "Append", "EventTime")
    return kept.select("hostname", "worker_id", F.timestamp_micros("us").alias("_time"))


def stream_resource_alerts(parsed: DataFrame) -> DataFrame:
    return resource_alerts(parsed)


CAPPED = "scan_id string, rule string, path string, n bigint, kind string, seen timestamp"
_CAPPED = ["scan_id", "rule", "path", "n", "kind", "seen"]


class PartCap(Bucket):
    """Passes the first ``cap`` alerts of a part of a scan, and of the others one row a rule and
    micro-batch with their number."""

    shape = "scan array<string>, part array<int>, sent array<bigint>"

    def __init__(self, cap: int):
        self.cap = cap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = {r[:2]: r[2] for r in self.kept()}
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["seen", "path", "rule"])
        groups = list(zip(_plain(pdf["scan_id"]), pdf["part"].tolist(), strict=True))
        first = _first(groups, kept, self.cap)
        self.keep([(*g, n) for g, n in kept.items()], [])
        yield pdf[first].assign(n=1, kind="alert")[_CAPPED]
        if not all(first):
            rest = pdf[[not x for x in first]]
            held = rest.groupby(["scan_id", "part", "rule"], dropna=False, as_index=False).agg(n=("seen", "size"), seen=("seen", "max"))
            yield held.assign(scan_id=_plain(held["scan_id"]), rule=_plain(held["rule"]), path=None, kind="held")[_CAPPED]


def _first(groups: list, sent: dict, cap: int) -> list[bool]:
    """Which rows are among the first ``cap`` of their group; ``sent`` counts on."""
    out = []
    for g in groups:
        n = sent.get(g, 0)
        out.append(n < cap)
        sent[g] = min(cap, n + 1)
    return out


class AlertCap(Bucket):
    """Passes the first ``cap`` alerts of a scan; counts the others by rule, and tells their
    sums when the scan has been silent for ``quiet_ms`` of event time."""

    #: Of a scan that was told of, the timer is null.
    shape = "scan array<string>, sent array<bigint>, timer array<bigint>, rules array<array<string>>, held array<array<bigint>>"

    def __init__(self, cap: int = 500, quiet_ms: int = 600_000):
        self.cap, self.quiet_ms = cap, quiet_ms

    def _keep(self, kept: dict) -> None:
        self.keep([(g, n, t, list(held), list(held.values())) for g, (n, t, held) in kept.items()], [t for _, t, _ in kept.values() if t is not None])

    def _kept(self) -> dict:
        return {g: [n, t, dict(zip(rules, held, strict=True))] for g, n, t, rules, held in self.kept()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = self._kept()
        pdf, first = pd.concat(list(rows), ignore_index=True).sort_values(["seen", "path", "rule"]), []
        for scan_, rule, n, kind, at in zip(_plain(pdf["scan_id"]), _plain(pdf["rule"]), pdf["n"].tolist(), pdf["kind"], _ms(pdf["seen"]).tolist(), strict=True):
            state = kept.setdefault(scan_, [0, None, {}])
            passed = kind == "alert" and state[0] < self.cap
            first.append(passed)
            if passed:
                state[0] += 1
            else:
                state[2][rule] = state[2].get(rule, 0) + n
            state[1] = max(state[1] or 0, at + self.quiet_ms)
        self._keep(kept)
        yield pdf[first][_CAPPED[:5]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.expired()
        kept, out = self._kept(), []
        for scan_, state in kept.items():
            if state[1] is not None and state[1] <= timerValues.getCurrentWatermarkInMs():
                out += sorted(((scan_, rule, None, n, "rollup") for rule, n in state[2].items()), key=lambda x: (-x[3], x[1] or ""))
                state[1:] = None, {}
        self._keep(kept)
        yield pd.DataFrame(out, columns=_CAPPED[:5])


ALERT_OUT = "scan_id string, rule string, path string, n bigint, kind string"
#: Parts of a scan that are capped on their own first.
CAP_PARTS = 32


def cap_stream(alerts: DataFrame, cap: int = 500, quiet_ms: int = 600_000, late: str = "10 minutes", parts: int = CAP_PARTS) -> DataFrame:
    """Alerts (scan_id, rule, path, _time) capped for each scan, with a rollup at its end.

    What is behind ``cap`` in a part of a scan's alerts is so in the scan. So parts are capped
    first, each with a state of its own, and the scan's state gets at most ``cap`` alerts of a part,
    and one row a rule, part and micro-batch for the others.
    """
    # Names in the state's rows mustn't begin with an underscore.
    timed = alerts.select("scan_id", "rule", "path", F.col("_time").alias("seen")).withWatermark("seen", late)
    parted = timed.withColumn("part", F.pmod(F.xxhash64("rule", "path"), F.lit(parts)).cast("int"))
    capped = dealt(parted, "scan_id", "part").groupBy("bucket").transformWithStateInPandas(PartCap(cap), CAPPED, "Append", "EventTime", eventTimeColumnName="seen")
    return dealt(capped, "scan_id").groupBy("bucket").transformWithStateInPandas(AlertCap(cap, quiet_ms), ALERT_OUT, "Append", "EventTime")


class StaleScan(Bucket):
    """Tells a scan that hasn't ended and has been silent for ``after_ms`` of event time."""

    shape, columns = "scan array<string>, ms array<bigint>, status array<string>", ["scan_id", "status", "last_ms"]

    def __init__(self, after_ms: int = 86_400_000):
        self.after_ms = after_ms

    def _due(self, rows: list[tuple]) -> list[int]:
        return [ms + self.after_ms for _, ms, status in rows if status not in TERMINAL]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = {r[0]: r for r in self.kept()}
        # The latest by event time decides, whatever the order of arrival.
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("event_timestamp_ms", kind="stable")
        latest = pdf.drop_duplicates("scan_id", keep="last")
        for r in zip(_plain(latest["scan_id"]), latest["event_timestamp_ms"].tolist(), _plain(latest["status"]), strict=True):
            if r[0] not in kept or r[1] >= kept[r[0]][1]:
                kept[r[0]] = r
        # Rows before the watermark come no more, so an end before it needn't be known.
        left = [r for r in kept.values() if r[2] not in TERMINAL or r[1] >= timerValues.getCurrentWatermarkInMs()]
        self.keep(left, self._due(left))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.expired()
        now = timerValues.getCurrentWatermarkInMs()
        stale = [r for r in self.kept() if r[2] not in TERMINAL and r[1] + self.after_ms <= now]
        gone = {r[0] for r in stale}
        left = [r for r in self.kept() if r[0] not in gone]
        self.keep(left, self._due(left))
        yield pd.DataFrame([(scan_, status, ms) for scan_, ms, status in stale], columns=self.columns)


def stale_scans(lifecycle: DataFrame, after_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """Scans (scan_id, status, last_ms) that went silent without an end."""
    timed = lifecycle.select("scan_id", "status", "event_timestamp_ms", F.timestamp_millis("event_timestamp_ms").alias("seen")).withWatermark("seen", late)
    return dealt(timed, "scan_id").groupBy("bucket").transformWithStateInPandas(StaleScan(after_ms), "scan_id string, status string, last_ms bigint", "Append", "EventTime")


BUCKETS = 64


def _version(version: int) -> str:
    return f"version={version:012d}"


def read_latest(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The table that :func:`upsert_latest` keeps, as of all versions (or those ``below``
    one), with its bucket; None before the first. Of each bucket the newest version counts."""
    newest: dict[str, str] = {}
    for name in sorted(folders_of(spark, table)):
        if name.startswith("version=") and (below is None or int(name[8:]) < below) and written(spark, f"{table}/{name}"):
            newest |= {b: f"{table}/{name}/{b}" for b in folders_of(spark, f"{table}/{name}")}
    if not newest:
        return None
    return spark.read.option("mergeSchema", "true").option("basePath", table).parquet(*newest.values()).drop("version")


def upsert_latest(table: str, order: str = "event_timestamp_ms", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the latest row of each scan by event time.

    Rows are in buckets by scan. A batch writes its buckets anew, as a version of its own
    number, from the newest versions below it; a batch that is tried again writes the same.
    Versions without a bucket that still counts are removed, but the last two stay. A batch
    without a column of the table raises and changes nothing.
    """

    def run(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64("scan_id"), F.lit(buckets)).cast("int"))
        before, rows = read_latest(spark, table, version), own
        if before is not None:
            if lost := set(before.columns) - set(own.columns):
                raise ValueError(f"the batch lacks {sorted(lost)}")
            touched = own.select("bucket").distinct()  # at most ``buckets`` rows
            rows = before.join(F.broadcast(touched), "bucket", "left_semi").unionByName(own, allowMissingColumns=True)
        ties = F.struct(order, *(c for c in rows.columns if c not in (order, "scan_id", "bucket")))
        latest = rows.groupBy("scan_id").agg(F.max_by(F.struct(*rows.columns), ties).alias("r")).select("r.*")
        latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/{_version(version)}")
        _forget(spark, table)

    return run


def _forget(spark: SparkSession, table: str) -> None:
    """Remove versions all of whose buckets have newer ones, the last two aside."""
    seen: set[str] = set()
    done = [n for n in sorted(folders_of(spark, table), reverse=True) if n.startswith("version=") and written(spark, f"{table}/{n}")]
    for i, name in enumerate(done):
        own = set(folders_of(spark, f"{table}/{name}"))
        if i >= 2 and own <= seen:
            remove(spark, f"{table}/{name}")
        seen |= own


def scan_new_files(rules: list[Rule], sink: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a corpus stream: the batch's file rows, in a partition of its
    number, which a batch that is tried again replaces."""

    def run(batch: DataFrame, version: int) -> None:
        scan(batch, rules).write.mode("overwrite").parquet(f"{sink}/batch={version}")

    return run
