"""Query panels over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import bin_millis, from_millis, top
from ..operators.lifecycle import latest_scan_state
from ..schemas import RULE_HIT

IDENTITY = ["scan_id", "hostname", "filename", "rule"]
DAY, HOUR = 86_400_000, 3_600_000


def deduped(findings: DataFrame) -> DataFrame:
    """One row for each match; older rows count by rule, current ones by file."""
    return findings.dropDuplicates(IDENTITY).withColumn("hits_n", F.coalesce("match_total", "match_count"))


def by_rule(findings: DataFrame) -> DataFrame:
    """One row for each rule of a match, with r.*; an older row stands for its one rule, and
    a row with neither array nor count vanishes. Copies go before rows multiply."""
    one = F.array(F.struct("rule", "match_count", F.array().cast("array<string>").alias("offsets"), F.array().cast("array<string>").alias("strings"), F.array().cast("array<struct<id:string,count:bigint>>").alias("string_ids"), "truncated", F.lower("severity").alias("severity")).cast(RULE_HIT))
    own = F.when(F.col("rules").isNotNull(), F.col("rules")).when(F.col("rule").isNotNull() & F.col("match_count").isNotNull(), one)
    rows = findings.dropDuplicates(IDENTITY).withColumn("__r", F.explode(own))
    return rows.drop("rule", "match_count").withColumn("rule", F.col("__r.rule")).withColumn("rule_hits", F.col("__r.match_count")).withColumn("rule_offsets", F.to_json("__r.offsets")).drop("__r")


def q1_hotspot_folders(findings: DataFrame, lifecycle: DataFrame) -> DataFrame:
    scans = latest_scan_state(lifecycle).select("scan_id", F.col("scan_folder").alias("folder"))
    out = deduped(findings).join(scans, "scan_id").groupBy("folder").agg(F.sum("hits_n").alias("hits"), F.countDistinct("file_sha256").alias("unique_files"))
    return top(out, 15, "hits", "folder")


def q2_by_os(findings: DataFrame) -> DataFrame:
    return deduped(findings).groupBy("os_type").agg(F.sum("hits_n").alias("hits"), F.countDistinct("hostname").alias("hosts"))


def q3_distinct_rules(findings: DataFrame) -> DataFrame:
    return by_rule(findings).agg(F.countDistinct("rule").alias("rules"))


def q4_endpoints_per_rule(findings: DataFrame) -> DataFrame:
    return top(by_rule(findings).groupBy("rule").agg(F.countDistinct("hostname").alias("hosts")), 15, "hosts", "rule")


def q5_triage_queue(findings: DataFrame) -> DataFrame:
    rows = by_rule(findings.where("severity = 'High'"))
    newest = rows.orderBy(F.desc("event_timestamp_ms"), "hostname", "filename", "rule").limit(25)
    return newest.select(from_millis("event_timestamp_ms").alias("scan_time"), "hostname", "os_type", "rule", "filename", "file_size", "rule_hits", "truncated", "rule_offsets", "file_sha256")


def q6_hot_hosts(findings: DataFrame) -> DataFrame:
    return top(deduped(findings).groupBy("hostname").agg(F.sum("hits_n").alias("hits")), 15, "hits", "hostname")


def q7_largest_files(findings: DataFrame) -> DataFrame:
    out = by_rule(findings).groupBy("filename", "rule", "hostname").agg(F.max("file_size").alias("bytes"), F.sum("rule_hits").alias("hits"))
    return top(out, 20, "bytes", "filename", "rule", "hostname")


def q8_hit_buckets(findings: DataFrame) -> DataFrame:
    n = F.col("rule_hits")
    bucket = F.when(n < 2, "01: 1 hit").when(n < 5, "02: 2-4 hits").when(n < 20, "03: 5-19 hits").when(n < 100, "04: 20-99 hits").otherwise("05: >=100 hits")
    return by_rule(findings).groupBy(bucket.alias("hit_bucket")).agg(F.count("*").alias("findings")).orderBy("hit_bucket")


def q9_over_time(findings: DataFrame) -> DataFrame:
    hour = F.timestamp_millis(bin_millis("event_timestamp_ms", HOUR))
    return deduped(findings).groupBy(hour.alias("hour")).agg(F.sum("hits_n").alias("hits")).orderBy("hour")


def q10_severity_split(findings: DataFrame) -> DataFrame:
    return deduped(findings).groupBy("severity").agg(F.sum("hits_n").alias("hits"))


def q11_top_files(findings: DataFrame) -> DataFrame:
    return top(deduped(findings).groupBy("filename", "file_sha256").agg(F.sum("hits_n").alias("hits")), 20, "hits", "filename", "file_sha256")


def q12_top_rules(findings: DataFrame) -> DataFrame:
    return top(by_rule(findings).groupBy("rule").agg(F.sum("rule_hits").alias("hits")), 15, "hits", "rule")


def q13_total(findings: DataFrame) -> DataFrame:
    return deduped(findings).agg(F.sum("hits_n").alias("hits"))


def q14_unique_files_per_rule(findings: DataFrame) -> DataFrame:
    out = by_rule(findings).groupBy("rule").agg(F.countDistinct("file_sha256").alias("unique_files"), F.sum("rule_hits").alias("hits"))
    return top(out, 15, "unique_files", "rule")
