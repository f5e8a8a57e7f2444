"""Documented one-off queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import contains, from_millis, to_integer, top
from ..schemas import FINISHED, MATCH
from .findings import by_rule, deduped


def d1_top_hosts(t: DataFrame, n: int = 25) -> DataFrame:
    return top(t.where(F.col("type") == MATCH).groupBy("hostname").agg(F.sum(to_integer("match_count")).alias("hits")), n, "hits", "hostname")


def d2_top_rules(t: DataFrame, n: int = 25) -> DataFrame:
    return top(t.where(F.col("type") == MATCH).groupBy("rule_id").agg(F.count("*").alias("findings"), F.countDistinct("hostname").alias("hosts")), n, "findings", "rule_id")


def d3_files_of_rule(t: DataFrame, rule: str) -> DataFrame:
    return t.where((F.col("type") == MATCH) & (F.col("rule_id") == rule)).select("_time", "hostname", "file_name", "match_count").orderBy(F.desc("_time"))


def d4_never_completed(t: DataFrame, start: str = "scanner_initialization", kinds: tuple[str, ...] = ("scanner_initialization", "scan_completion_summary")) -> DataFrame:
    """Scans with rows of the start kind only, of the two kinds."""
    out = t.where(F.col("type").isin(*kinds)).groupBy("scan_id", "hostname").agg(F.collect_set("type").alias("types"))
    return out.where((F.size("types") == 1) & F.array_contains("types", start)).select("scan_id", "hostname")


def d5_correlation(t: DataFrame) -> DataFrame:
    title = F.concat(F.lit("YARA Match: "), F.col("rule_id"), F.lit(" on "), F.col("hostname"))
    return t.where(F.col("type") == MATCH).select("_time", title.alias("alert_name"), F.col("level").alias("severity"), F.col("file_name"), "scan_id")


def d6_finished(t: DataFrame) -> DataFrame:
    return t.where(contains("message", FINISHED)).groupBy("hostname").agg(F.count("*").alias("completions"))


def d7_completions(t: DataFrame, kind: str = "scan_completion_summary") -> DataFrame:
    return t.where(F.col("type") == kind).orderBy(F.desc("_time"), "data").limit(20).select("_time", "hostname", "data")


def d8_parse_check(t: DataFrame) -> DataFrame:
    return t.where(F.col("type") == MATCH).orderBy(F.desc("_time"), "data").limit(100).select("_time", "hostname", "rule_id", "file_name", "match_count")


def d9_scan_totals(findings: DataFrame) -> DataFrame:
    """Rows, rule-file pairs and hits of each scan."""
    rows = deduped(findings)
    return rows.groupBy("scan_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("rule_count", F.lit(1))).alias("pairs"), F.sum("hits_n").alias("hits"))


def d10_unfinished_runs(runs: DataFrame) -> DataFrame:
    """Started rows whose next row isn't a terminal one. Rows are put in order day by day;
    a day's last row is followed by the next day's first, of which there is one a day."""
    rows = runs.select("run_ts_ms", "status", F.floor(F.col("run_ts_ms") / 86_400_000).alias("day"))
    heads = rows.groupBy("day").agg(F.min(F.struct("run_ts_ms", "status"))["status"].alias("head"))
    after = heads.select("day", F.lead(F.struct("head")).over(Window.orderBy("day")).alias("next"))
    inside = F.lead(F.struct("status")).over(Window.partitionBy("day").orderBy("run_ts_ms", "status"))
    followed = rows.withColumn("own", inside).join(after, "day")
    following = F.when(F.col("own").isNotNull(), F.col("own.status")).otherwise(F.col("next.head"))
    return followed.where((F.col("status") == "started") & (following.isNull() | (following == "started"))).select("run_ts_ms", "status")


def d11_rules_per_scan(findings: DataFrame) -> DataFrame:
    return by_rule(findings).groupBy("scan_id", "hostname", "rule").agg(F.count("*").alias("files"))


def d12_cleanup_history(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_ts_ms"), "status").limit(20).withColumn("run_time", from_millis("run_ts_ms"))


def d13_rows_per_scan(table: DataFrame) -> DataFrame:
    return table.groupBy("scan_id").agg(F.count("*").alias("n"))


def d14_host_matches(findings: DataFrame, host: str) -> DataFrame:
    return findings.where(F.col("hostname") == host).orderBy(F.desc("event_timestamp_ms"), "filename").limit(20).select("scan_id", "filename", "severity", "match_total", "event_timestamp_ms")


def d15_rows_by_date(table: DataFrame) -> DataFrame:
    return table.groupBy(F.date_format(F.timestamp_millis("event_timestamp_ms"), "yyyyMMdd").alias("scan_date")).agg(F.count("*").alias("n"))


def d16_latest_ingested(lifecycle: DataFrame, ingest: str = "_insert_time") -> DataFrame:
    ties = [c for c in ("event_id", "scan_id") if c in lifecycle.columns]
    return lifecycle.orderBy(F.desc(ingest), *(F.desc(c) for c in ties)).limit(10)


def d17_v3_top_rules(v3: DataFrame) -> DataFrame:
    """Over scalar rules, copies included."""
    return top(v3.groupBy("rule").agg(F.sum("match_count").alias("hits")), 15, "hits", "rule")


def d18_target_rows(table: DataFrame, scan_id: str) -> DataFrame:
    return table.where(F.col("scan_id") == scan_id).agg(F.count("*").alias("n"))


def d19_host_history(lifecycle: DataFrame, host: str) -> DataFrame:
    return lifecycle.where(F.col("hostname") == host).orderBy(F.desc("event_timestamp_ms")).select("event_timestamp_ms", "scan_id", "status", "files_scanned", "detections")
