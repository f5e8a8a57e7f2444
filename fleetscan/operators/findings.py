"""Findings: hits gathered by rule and by file, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RULE_HIT, severity_rank
from .scan import KEYS, Rule, scan_files

SAMPLE_CAP = 50
#: Parts that a scan's or rule's rows are put in order in first.
PARTS = 64


def rule_table(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, severity, tags and meta of a pack as a table."""
    rows = [(r.rule, r.severity, list(r.tags), dict(r.meta)) for r in rules]
    return df.sparkSession.createDataFrame(rows, "rule string, severity string, tags array<string>, meta map<string,string>")


def findings_agg(hits: DataFrame, fired: DataFrame, rules: list[Rule], sample_cap: int = SAMPLE_CAP) -> DataFrame:
    """A row for each (file, rule) that fired: the plain form of :func:`findings`, step by step, with
    a window over all hits of a (file, rule), for small tables and comparison.

    match_count and string_ids (the census) count every hit. offsets, strings, samples and
    sample_rows hold the first ``sample_cap`` hits in order (0: all); truncated tells that
    there were more. A rule that fired without strings has match_count 1 and no samples.
    """
    each = hits.groupBy(*KEYS, "rule", "string_id").agg(F.count("*").alias("count"))
    totals = each.groupBy(*KEYS, "rule").agg(F.sum("count").alias("match_count"), F.sort_array(F.collect_list(F.struct(F.col("string_id").alias("id"), "count"))).alias("string_ids"))
    order = Window.partitionBy(*KEYS, "rule").orderBy("offset", "string_id", "matched")
    numbered = hits.withColumn("__n", F.row_number().over(order))
    first = numbered.where(F.col("__n") <= sample_cap) if sample_cap else numbered
    sampled = first.groupBy(*KEYS, "rule").agg(F.sort_array(F.collect_list(F.struct(F.col("__n").alias("i"), "offset", "string_id", "matched"))).alias("sample_rows"))
    got = totals.join(sampled, [*KEYS, "rule"])
    rows = fired.join(got, [*KEYS, "rule"], "left").join(F.broadcast(rule_table(hits, rules)), "rule", "left")  # a row for each rule of the bounded pack
    none = F.array()
    sample = F.coalesce("sample_rows", none.cast("array<struct<i:int,offset:bigint,string_id:string,matched:string>>"))
    return rows.select(
        *KEYS,
        "rule",
        "match_scope",
        "severity",
        "tags",
        "meta",
        F.coalesce("match_count", F.lit(1)).alias("match_count"),
        F.get(F.transform(sample, lambda s: s["offset"]), F.lit(0)).alias("first_offset"),
        F.transform(sample, lambda s: s["offset"].cast("string")).alias("offsets"),
        F.array_distinct(F.transform(sample, lambda s: s["matched"])).alias("strings"),
        F.transform(F.slice(sample, 1, 3), lambda s: F.concat(s["string_id"], F.lit("@"), s["offset"].cast("string"))).alias("samples"),
        F.coalesce("string_ids", none.cast("array<struct<id:string,count:bigint>>")).alias("string_ids"),
        (F.coalesce("match_count", F.lit(0)) > F.size(sample)).alias("truncated"),
        sample.alias("sample_rows"),
    )


def max_severity(col: str) -> Column:
    """Aggregate: the severest value as it is spelled."""
    return F.max_by(F.col(col), F.struct(severity_rank(col), F.col(col)))


def file_identity(corpus: DataFrame) -> DataFrame:
    """Keys, file_size (-1: unknown) and file_sha256 of the files; apply to matched ones."""
    body = F.col("content").cast("binary")
    return corpus.select(*KEYS, F.coalesce(F.octet_length(body).cast("bigint"), F.lit(-1)).alias("file_size"), F.sha2(body, 256).alias("file_sha256"))


def file_rows(findings: DataFrame, corpus: DataFrame, os_type: str = "os_type", stamp: str = "event_timestamp_ms") -> DataFrame:
    """A row for each file with a finding, its rules in an array; none for other files: the plain
    form of :func:`scan`, which reads the corpus once more.

    Contents are hashed for matched files only, after the join has dropped the rest.
    """
    one = F.struct("rule", "match_count", "offsets", "strings", "string_ids", "truncated", "severity").cast(RULE_HIT)
    files = findings.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(one)).alias("rules"), F.count("*").alias("rule_count"), F.sum("match_count").alias("match_total"), F.bool_or("truncated").alias("truncated"), max_severity("severity").alias("severity")
    )
    known = corpus.join(files.select(*KEYS), list(KEYS), "left_semi")
    identity = known.select(*KEYS, F.col(os_type).alias("os_type"), F.col(stamp).alias("event_timestamp_ms"), F.coalesce(F.octet_length(F.col("content").cast("binary")).cast("bigint"), F.lit(-1)).alias("file_size"), F.sha2(F.col("content").cast("binary"), 256).alias("file_sha256"))
    label = F.initcap("severity")
    return files.join(identity, list(KEYS)).select("scan_id", "hostname", "os_type", F.col("path").alias("filename"), "file_size", "file_sha256", label.alias("severity"), "match_total", "rule_count", "truncated", "event_timestamp_ms", "rules")


CARRIED = ("os_type", "event_timestamp_ms")


def findings(corpus: DataFrame, rules: list[Rule], sample_cap: int = SAMPLE_CAP) -> DataFrame:
    """The rows of :func:`findings_agg` for a corpus, in one pass over its contents and
    without a shuffle."""
    rows, sample = scan_files(corpus, rules, sample_cap, about=True), F.col("sample_rows")
    return rows.select(
        *KEYS,
        "rule",
        "match_scope",
        "severity",
        "tags",
        "meta",
        "match_count",
        F.get(F.transform(sample, lambda s: s["offset"]), F.lit(0)).alias("first_offset"),
        F.transform(sample, lambda s: s["offset"].cast("string")).alias("offsets"),
        F.array_distinct(F.transform(sample, lambda s: s["matched"])).alias("strings"),
        F.transform(F.slice(sample, 1, 3), lambda s: F.concat(s["string_id"], F.lit("@"), s["offset"].cast("string"))).alias("samples"),
        F.transform("ids", lambda s: F.struct(s["id"].alias("id"), s["count"].alias("count"))).alias("string_ids"),
        ((F.size(sample) > 0) & (F.col("match_count") > F.size(sample))).alias("truncated"),
        "sample_rows",
    )


def scan(corpus: DataFrame, rules: list[Rule], sample_cap: int = SAMPLE_CAP) -> DataFrame:
    """The whole scan: file rows of a corpus (scan_id, hostname, os_type, path, content,
    event_timestamp_ms). Equal to :func:`file_rows` of :func:`findings_agg`, in one pass over
    the contents and one shuffle of a small row for each (file, rule)."""
    found = scan_files(corpus, rules, sample_cap, CARRIED)
    sample = F.col("sample_rows")
    one = F.struct(
        "rule",
        "match_count",
        F.transform(sample, lambda s: s["offset"].cast("string")).alias("offsets"),
        F.array_distinct(F.transform(sample, lambda s: s["matched"])).alias("strings"),
        F.transform("ids", lambda s: F.struct(s["id"].alias("id"), s["count"].alias("count"))).alias("string_ids"),
        ((F.size(sample) > 0) & (F.col("match_count") > F.size(sample))).alias("truncated"),
        "severity",
    ).cast(RULE_HIT)
    files = found.select(*KEYS, *CARRIED, "file_size", "file_sha256", one.alias("r")).groupBy(*KEYS).agg(
        *(F.first(c).alias(c) for c in (*CARRIED, "file_size", "file_sha256")),
        F.sort_array(F.collect_list("r")).alias("rules"),
        F.count("*").alias("rule_count"),
        F.sum("r.match_count").alias("match_total"),
        F.bool_or("r.truncated").alias("truncated"),
        max_severity("r.severity").alias("severity"),
    )
    return files.select("scan_id", "hostname", "os_type", F.col("path").alias("filename"), "file_size", "file_sha256", F.initcap("severity").alias("severity"), "match_total", "rule_count", "truncated", "event_timestamp_ms", "rules")


def rule_only_detail(findings: DataFrame) -> DataFrame:
    """detail: what a rule that matched without strings looked for, from its metadata."""
    text = F.concat_ws(
        "; ",
        F.concat(F.lit("Rule condition matched without string hits: "), F.col("rule")),
        F.concat(F.lit("description: "), F.try_element_at("meta", F.lit("description"))),
        F.concat(F.lit("author: "), F.try_element_at("meta", F.lit("author"))),
        F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", "))),
    )
    return findings.withColumn("detail", F.when(F.col("match_scope") == "rule", text))


def match_events(findings: DataFrame) -> DataFrame:
    """An event for each finding; offsets and strings are aligned samples, repeats kept."""
    rows = F.col("sample_rows")
    data = F.struct(
        F.col("path").alias("filename"),
        "rule",
        "match_scope",
        "match_count",
        F.transform(rows, lambda s: s["offset"]).alias("offsets"),
        F.transform(rows, lambda s: s["matched"]).alias("strings"),
        F.map_from_entries(F.transform("string_ids", lambda s: F.struct(s["id"], s["count"]))).alias("match_ids"),
        "truncated",
    )
    return findings.select("scan_id", "hostname", F.lit("yara_match").alias("type"), F.col("severity").alias("level"), F.to_json(data).alias("data"))


def to_v3(files: DataFrame) -> DataFrame:
    """A row for each (rule, file), arrays as JSON text."""
    r = files.withColumn("r", F.explode("rules"))
    return r.select("scan_id", "hostname", "os_type", "filename", "file_size", "file_sha256", F.initcap("r.severity").alias("severity"), "r.rule", "r.match_count", F.to_json("r.offsets").alias("offsets"), F.to_json("r.strings").alias("strings"), F.to_json("r.string_ids").alias("string_ids"), "r.truncated", "event_timestamp_ms")


def to_v2(files: DataFrame) -> DataFrame:
    """A row for each sampled offset."""
    r = files.withColumn("r", F.explode("rules"))
    return r.select("scan_id", "hostname", "os_type", "filename", "file_size", "file_sha256", F.initcap("r.severity").alias("severity"), "r.rule", F.explode("r.offsets").alias("offset"), "event_timestamp_ms")


def detection_breakdown(findings: DataFrame, n: int = 10) -> DataFrame:
    """The n rules with most findings; total and unique_rules are of all rules."""
    counts = findings.groupBy("rule").agg(F.count("*").alias("detections"))
    whole = counts.agg(F.sum("detections").alias("total"), F.count("*").alias("unique_rules"))
    return counts.orderBy(F.desc("detections"), "rule").limit(n).crossJoin(whole)  # one row of sums


def evidence_manifest(files: DataFrame) -> DataFrame:
    return files.select("scan_id", "hostname", "filename", "file_size", "file_sha256")


def evidence_unique(files: DataFrame) -> DataFrame:
    """One file for each content: the first by host and name."""
    return files.groupBy("file_sha256").agg(F.min(F.struct("hostname", "filename", "file_size", "scan_id")).alias("f"), F.count("*").alias("copies")).select("file_sha256", "f.hostname", "f.filename", "f.file_size", "f.scan_id", "copies")


def rule_report(findings: DataFrame, budget: int = 65536) -> DataFrame:
    """Text for each rule of a scan: header, census and one line a file, in order. A line
    that would pass the byte budget is left out; the counts in the header stay whole."""
    line = F.concat(F.col("path"), F.lit(": "), F.col("match_count").cast("string"), F.lit(" hits "), F.array_join("samples", ", "))
    rows = findings.withColumn("line", line)
    # A rule may have any number of files. Within a part of them, a line behind one that
    # passes the budget can't stay, so few lines are left to be put in order as a whole.
    part, before = F.pmod(F.xxhash64("path"), F.lit(PARTS)), Window.unboundedPreceding
    rows = rows.withColumn("__part", part).withColumn("__size", F.octet_length("line") + 1)
    inner = Window.partitionBy("scan_id", "hostname", "rule", "__part").orderBy("path")
    rows = rows.withColumn("__near", F.coalesce(F.sum("__size").over(inner.rowsBetween(before, -1)) <= budget, F.lit(True)))
    outer = Window.partitionBy("scan_id", "hostname", "rule", F.when(F.col("__near"), F.lit(-1)).otherwise(F.col("__part"))).orderBy("path")
    fits = F.col("__near") & (F.sum("__size").over(outer.rowsBetween(before, 0)) <= budget)
    kept = rows.withColumn("line", F.when(fits, F.col("line")))
    out = kept.groupBy("scan_id", "hostname", "rule").agg(F.count("*").alias("files"), F.sum("match_count").alias("hits"), F.sort_array(F.collect_list("line")).alias("lines"), F.count(F.when(F.col("line").isNull(), 1)).alias("dropped_lines"))
    head = F.concat(F.lit("Rule "), F.col("rule"), F.lit(": "), F.col("hits").cast("string"), F.lit(" hits in "), F.col("files").cast("string"), F.lit(" files"))
    return out.select("scan_id", "hostname", "rule", "files", "hits", "dropped_lines", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("report"))

