"""Scan lifecycle rows and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import dedup_latest


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, F.round(a.cast("double") / b, digits)).otherwise(F.lit(0.0))


def terminal_status() -> Column:
    """Of cancelled, failed and completed flags the first that holds, in this order."""
    return F.when(F.col("cancelled"), "cancelled").when(F.col("failed"), "failed").otherwise("completed")


def lifecycle_rows(scope: DataFrame, findings: DataFrame, ruleset: DataFrame, timing: DataFrame) -> DataFrame:
    """A row for each scan and host, from classified files, findings, the pack's statuses
    and timing (scan_id, hostname, elapsed_secs, cancelled, failed)."""
    files = scope.groupBy("scan_id", "hostname").agg(F.count(F.when(F.col("scannable"), 1)).alias("files_scanned"), F.count(F.when(~F.col("scannable"), 1)).alias("files_skipped"))
    found = findings.groupBy("scan_id", "hostname").agg(F.count("*").alias("detections"))
    rules = ruleset.agg(F.count(F.when(F.col("status") == "valid", 1)).alias("valid_rules"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed_rules"))
    rows = timing.join(files, ["scan_id", "hostname"], "left").join(found, ["scan_id", "hostname"], "left").crossJoin(F.broadcast(rules))  # one row of counts
    filled = rows.fillna(0, ["files_scanned", "files_skipped", "detections"])
    return filled.select("scan_id", "hostname", terminal_status().alias("status"), "files_scanned", "files_skipped", "detections", "valid_rules", "failed_rules", ratio(F.col("files_scanned"), F.col("elapsed_secs"), 2).alias("scan_rate_fps"), "elapsed_secs")


def latest_scan_state(lifecycle: DataFrame) -> DataFrame:
    """The newest row of each scan by event time; equal times by the remaining columns."""
    ties = [c for c in lifecycle.columns if c not in ("scan_id", "event_timestamp_ms")]
    first = ["event_id"] if "event_id" in ties else []
    return dedup_latest(lifecycle, ["scan_id"], "event_timestamp_ms", *first, *(c for c in ties if c not in first))


def heartbeat_gaps(lifecycle: DataFrame, expected_secs: int = 600) -> DataFrame:
    """Running rows with the seconds since the one before, and late where over expected."""
    order = Window.partitionBy("scan_id").orderBy("event_timestamp_ms")
    gap = (F.col("event_timestamp_ms") - F.lag("event_timestamp_ms").over(order)) / 1000
    return lifecycle.where("status = 'running'").withColumn("gap_secs", gap).withColumn("late", F.coalesce(F.col("gap_secs") > expected_secs, F.lit(False)))


def final_metrics(rows: DataFrame) -> DataFrame:
    """detection_rate, skip_rate and path_deduplication_ratio; 0 over nothing."""
    seen = F.col("files_scanned") + F.col("files_skipped")
    unique = F.col("unique_real_paths") if "unique_real_paths" in rows.columns else F.col("files_scanned")
    return rows.withColumns({"detection_rate": ratio(F.col("detections"), F.col("files_scanned")), "skip_rate": ratio(F.col("files_skipped"), seen), "path_deduplication_ratio": ratio(unique, F.col("files_scanned"))})


def final_report(rows: DataFrame) -> DataFrame:
    """compile_success_pct, processing_rate and efficiency (100 less 20 times the skip rate
    and 30 times the share of failed rules, 0 at least)."""
    seen = F.col("files_scanned") + F.col("files_skipped")
    rules = F.col("valid_rules") + F.col("failed_rules")
    lost = ratio(F.col("files_skipped"), seen, 12) * 20 + ratio(F.col("failed_rules"), rules, 12) * 30
    return rows.withColumns({"compile_success_pct": F.round(ratio(F.col("valid_rules"), rules, 12) * 100, 2), "processing_rate": ratio(F.col("files_scanned"), F.col("elapsed_secs"), 2), "efficiency": F.round(F.greatest(F.lit(0.0), 100 - lost), 2)})


def delivery_shortfall(queued: DataFrame, landed: DataFrame) -> DataFrame:
    """queued, landed and lost for each scan and channel; what isn't confirmed is lost."""
    q = queued.groupBy("scan_id", "channel").agg(F.sum("n").alias("queued"))
    d = landed.groupBy("scan_id", "channel").agg(F.sum("n").alias("landed"))
    both = q.join(d, ["scan_id", "channel"], "full_outer").fillna(0, ["queued", "landed"])
    return both.withColumn("lost", F.greatest(F.col("queued") - F.col("landed"), F.lit(0))).withColumn("note", F.when(F.col("lost") > 0, F.concat(F.col("lost").cast("string"), F.lit(" of "), F.col("queued").cast("string"), F.lit(" undelivered on "), F.col("channel"))))


def time_estimates(progress: DataFrame) -> DataFrame:
    """rate, files_remaining, eta_seconds and recent_rate (over up to 60 snapshots) from
    processed, total, elapsed_secs and event_timestamp_ms of a scan."""
    order = Window.partitionBy("scan_id").orderBy("event_timestamp_ms")
    recent = order.rowsBetween(-59, 0)
    gained = F.col("processed") - F.first("processed").over(recent)
    secs = (F.col("event_timestamp_ms") - F.first("event_timestamp_ms").over(recent)) / 1000
    rate = ratio(F.col("processed"), F.col("elapsed_secs"), 12)
    left = F.greatest(F.col("total") - F.col("processed"), F.lit(0))
    return progress.withColumns({"rate": F.round(rate, 6), "files_remaining": left, "eta_seconds": F.when(rate > 0, F.round(left / rate, 6)), "recent_rate": ratio(gained, secs)})


def worker_summary(work: DataFrame) -> DataFrame:
    """files, mean milliseconds and error percentage of each worker (files, ms, errors)."""
    return work.groupBy("worker_id").agg(F.sum("files").alias("files"), ratio(F.sum("ms"), F.sum("files")).alias("mean_ms"), ratio(F.sum("errors") * 100, F.sum("files")).alias("error_pct"))


def scan_summary(lifecycle: DataFrame, findings: DataFrame, n: int = 10) -> DataFrame:
    """Latest state, rates and the n rules with most findings of each scan."""
    counts = findings.groupBy("scan_id", "rule").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("c"), "rule"))
    tops = counts.withColumn("i", place).where(F.col("i") <= n).groupBy("scan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "rule", "c"))), lambda s: F.struct(s["rule"].alias("rule"), s["c"].alias("detections"))).alias("top_rules"))
    return final_metrics(latest_scan_state(lifecycle)).join(tops, "scan_id", "left")


def verify_host(table: DataFrame, host: str, n: int = 20, stamp: str = "event_timestamp_ms") -> DataFrame:
    """The last n rows of one host."""
    return table.where(F.col("hostname") == host).orderBy(F.desc(stamp), *(c for c in ("scan_id", "filename") if c in table.columns)).limit(n)
