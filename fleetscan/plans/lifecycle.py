"""Query panels over scan lifecycle, the compaction log and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import bin_millis, bin_time, divide, from_millis, top
from ..operators.lifecycle import latest_scan_state
from ..schemas import ALERT_MARK, RUNNING
from .findings import DAY


def _done(lifecycle: DataFrame) -> DataFrame:
    """Scans whose latest state is completed."""
    return latest_scan_state(lifecycle).where("status = 'completed'")


def _day() -> Column:
    return F.timestamp_millis(bin_millis("event_timestamp_ms", DAY)).alias("day")


def q15_active(lifecycle: DataFrame) -> DataFrame:
    rows = latest_scan_state(lifecycle).where(F.col("status").isin(*RUNNING))
    return rows.select("hostname", "scan_id", "status", "files_scanned", "detections", "throttle_mode", "event_timestamp_ms")


def q16_cancelled(lifecycle: DataFrame) -> DataFrame:
    ties = [c for c in ("event_id",) if c in lifecycle.columns] or ["scan_id"]
    rows = lifecycle.where("status = 'cancelled'").orderBy(F.desc("event_timestamp_ms"), *(F.desc(c) for c in ties)).limit(50)
    return rows.select("hostname", "scan_id", "files_scanned", "detections", "total_paused_secs", "message")


def q17_clean(lifecycle: DataFrame) -> DataFrame:
    label = F.when(F.col("detections") > 0, "With matches").otherwise("Clean")
    return _done(lifecycle).groupBy(label.alias("result")).agg(F.count("*").alias("scans"))


def q18_coverage_gaps(lifecycle: DataFrame) -> DataFrame:
    out = latest_scan_state(lifecycle).groupBy("hostname", "os_type").agg(F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("completed"), F.count("*").alias("scans"))
    return out.where("completed = 0").select("hostname", "os_type", "scans")


def q19_distinct_hosts(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.agg(F.countDistinct("hostname").alias("hosts"))


def q20_failed_rule_trend(lifecycle: DataFrame) -> DataFrame:
    return latest_scan_state(lifecycle).groupBy(_day()).agg(F.sum("failed_rules").alias("failed_rules")).orderBy("day")


def q21_files_by_os(lifecycle: DataFrame) -> DataFrame:
    return latest_scan_state(lifecycle).groupBy("os_type").agg(F.sum("files_scanned").alias("files"))


def q22_completed_files_by_os(lifecycle: DataFrame) -> DataFrame:
    return _done(lifecycle).groupBy("os_type").agg(F.sum("files_scanned").alias("files"))


def q23_started_completed(lifecycle: DataFrame) -> DataFrame:
    out = latest_scan_state(lifecycle).groupBy("hostname").agg(F.count("*").alias("started"), F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("completed"))
    return out.withColumn("gap", F.col("started") - F.col("completed"))


def q24_pack_failures(lifecycle: DataFrame) -> DataFrame:
    out = latest_scan_state(lifecycle).where("failed_rules > 0").groupBy("hostname").agg(F.sum("failed_rules").alias("failed_rules"))
    return top(out, 15, "failed_rules", "hostname")


def q25_completions(lifecycle: DataFrame) -> DataFrame:
    return _done(lifecycle).groupBy(_day()).agg(F.count("*").alias("scans")).orderBy("day")


def q26_duration(lifecycle: DataFrame) -> DataFrame:
    out = latest_scan_state(lifecycle.where("status = 'completed'"))
    return out.groupBy("hostname").agg(F.round(F.avg("elapsed_secs"), 6).alias("avg_secs"), F.sum("files_scanned").alias("files"))


def q27_rate_leaders(lifecycle: DataFrame) -> DataFrame:
    return top(_done(lifecycle).groupBy("hostname").agg(F.round(F.avg("scan_rate_fps"), 6).alias("avg_fps")), 15, "avg_fps", "hostname")


def q28_by_os(lifecycle: DataFrame) -> DataFrame:
    return latest_scan_state(lifecycle).groupBy("os_type").agg(F.count("*").alias("scans"))


def q29_by_status(lifecycle: DataFrame) -> DataFrame:
    return latest_scan_state(lifecycle).groupBy("status").agg(F.count("*").alias("scans"))


def q30_signal_density(lifecycle: DataFrame) -> DataFrame:
    """A ratio of sums."""
    out = _done(lifecycle).where("files_scanned > 0").groupBy("hostname").agg(F.sum("detections").alias("d"), F.sum("files_scanned").alias("f"))
    return top(out.select("hostname", F.round(1000 * divide(F.col("d"), F.col("f")), 6).alias("per_1k")), 15, "per_1k", "hostname")


def q31_slowest(lifecycle: DataFrame) -> DataFrame:
    return top(_done(lifecycle).select("hostname", "scan_id", "elapsed_secs", "files_scanned"), 20, "elapsed_secs", "hostname", "scan_id")


def q32_throttle_modes(lifecycle: DataFrame) -> DataFrame:
    return latest_scan_state(lifecycle).groupBy("throttle_mode").agg(F.count("*").alias("scans"))


def q33_throttle_overhead(lifecycle: DataFrame) -> DataFrame:
    """A mean of each scan's ratio."""
    share = 100 * divide(F.col("total_paused_secs"), F.col("elapsed_secs"))
    out = _done(lifecycle).where("elapsed_secs > 0").groupBy("hostname").agg(F.round(F.avg(share), 6).alias("paused_pct"))
    return top(out, 15, "paused_pct", "hostname")


def q34_total_files(lifecycle: DataFrame) -> DataFrame:
    """Over every lifecycle row."""
    return lifecycle.agg(F.sum("files_scanned").alias("files"))


def q35_paused(lifecycle: DataFrame) -> DataFrame:
    return latest_scan_state(lifecycle.where("status = 'completed'")).groupBy("hostname").agg(F.round(F.sum("total_paused_secs"), 6).alias("paused_secs"))


def q36_total_scans(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.agg(F.countDistinct("scan_id").alias("scans"))


def q37_rules_per_scan(lifecycle: DataFrame) -> DataFrame:
    out = _done(lifecycle).select("scan_id", "hostname", "valid_rules", "failed_rules", (F.col("valid_rules") + F.col("failed_rules")).alias("total_rules"))
    return top(out, 20, "failed_rules", "scan_id")


def q38_compaction_runs(runs: DataFrame) -> DataFrame:
    newest = runs.orderBy(F.desc("run_ts_ms"), "status", "consolidated_count", "failed_count", "failed_scan_ids").limit(20)
    return newest.select(from_millis("run_ts_ms").alias("run_time"), "status", "consolidated_count", "failed_count", "failed_scan_ids", "error_message")


def q39_alerting_rules(alerts: DataFrame) -> DataFrame:
    out = alerts.where(F.col("alert_name").contains(ALERT_MARK)).groupBy("alert_name").agg(F.count("*").alias("alerts"))
    return top(out, 15, "alerts", "alert_name")


def q40_alert_severity(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("alert_name").contains(ALERT_MARK)).groupBy("severity").agg(F.count("*").alias("alerts"))


def q41_alert_volume(alerts: DataFrame) -> DataFrame:
    out = alerts.where(F.col("alert_name").contains(ALERT_MARK)).groupBy(bin_time("_time", "1 day").alias("day")).agg(F.count("*").alias("alerts"))
    return out.orderBy("day")
