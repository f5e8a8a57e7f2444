"""Query panels over parsed telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stages import bin_time, contains, dedup_latest, divide, json_scalar, latest, to_float, to_integer, top
from ..schemas import ESTIMATES, FINISHED, MATCH, PERFORMANCE, PROGRESS, SNAPSHOT, STARTED, STATISTICS, SUMMARY


def _of(t: DataFrame, kind: str, message: str | None = None) -> DataFrame:
    rows = t.where(F.col("type") == kind)
    return rows.where(F.col("message").contains(message)) if message else rows


def _newest(t: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each host (or further keys); null keys aside."""
    return dedup_latest(t.where(F.col("hostname").isNotNull()), list(keys or ("hostname",)), "_time", "data")


def _mean(col, name: str):
    return F.round(F.avg(col), 6).alias(name)


def e1_fleet_inventory(t: DataFrame) -> DataFrame:
    rows = _newest(_of(t, SUMMARY).where("platform is not null"))
    return rows.groupBy("platform", "yara_version", "python_version").agg(F.countDistinct("hostname").alias("hosts"))


def scan_window(t: DataFrame) -> DataFrame:
    """(host, start_time, end_time): the latest start of each host and the first completion
    after it; hosts without a completion are left out. Messages match in any case."""
    starts = _of(t, PERFORMANCE).where(contains("message", STARTED, False) & F.col("hostname").isNotNull()).groupBy(F.col("hostname").alias("host")).agg(F.max("_time").alias("start_time"))
    ends = t.where(contains("message", FINISHED, False) & F.col("hostname").isNotNull()).select(F.col("hostname").alias("host"), F.col("_time").alias("completed"))
    return starts.join(ends, "host").where("completed >= start_time").groupBy("host").agg(F.min("start_time").alias("start_time"), F.min("completed").alias("end_time"))


def _while_scanning(t: DataFrame, present: str, value: str, name: str) -> DataFrame:
    """The mean over hosts of each host's mean inside its window, cut to a whole number."""
    snaps = _of(t, SNAPSHOT).where(F.col(present).isNotNull() & F.col("hostname").isNotNull()).select(F.col("hostname").alias("host"), "_time", to_float(value).alias("v"))
    inside = snaps.join(scan_window(t), "host").where("_time between start_time and end_time")
    return inside.groupBy("host").agg(F.avg("v").alias("v")).agg(F.avg("v").cast("bigint").alias(name))


def e2_process_memory(t: DataFrame) -> DataFrame:
    return _while_scanning(t, "sys_memory_used_percent", "proc_memory_mb", "avg_proc_mem_mb")


def e3_process_cpu(t: DataFrame) -> DataFrame:
    return _while_scanning(t, "sys_cpu_percent", "proc_cpu_percent", "avg_proc_cpu_percent")


def e4_system_cpu(t: DataFrame) -> DataFrame:
    return _while_scanning(t, "sys_cpu_percent", "sys_cpu_percent", "avg_sys_cpu_percent")


def e5_system_memory(t: DataFrame) -> DataFrame:
    return _while_scanning(t, "sys_memory_used_percent", "sys_memory_used_percent", "avg_sys_mem_percent")


def e6_capacity(t: DataFrame) -> DataFrame:
    """Hourly means of both metrics from one pass, as shares of each metric's largest."""
    rows = _of(t, STATISTICS, PROGRESS).where("active_workers is not null and queue_size is not null")
    hourly = rows.groupBy(bin_time("_time", "1 hour").alias("hour")).agg(F.avg(to_integer("active_workers")).alias("Workers"), F.avg(to_integer("queue_size")).alias("Queue"))
    long = hourly.unpivot("hour", ["Workers", "Queue"], "metric", "value")
    most = long.groupBy("metric").agg(F.max("value").alias("m"))
    share = F.when(F.col("m") == 0, 0.0).otherwise(F.round(100 * divide(F.col("value"), F.col("m")), 6))
    return long.join(most, "metric").select("hour", "metric", F.round("value", 6).alias("value"), share.alias("value_index"))


def e7_completed(t: DataFrame) -> DataFrame:
    return t.where(F.col("message").contains(FINISHED) & F.col("data").isNotNull()).select("hostname").distinct().agg(F.count("*").alias("scan_completed"))


def e8_density(t: DataFrame) -> DataFrame:
    rows = _newest(_of(t, STATISTICS, PROGRESS).where("files_scanned is not null")).select("hostname", to_float("files_scanned").alias("scanned"), to_float("total_detections").alias("dets"))
    density = F.when(F.col("scanned") > 0, F.round(divide(F.col("dets"), F.col("scanned")) * 1000, 6)).otherwise(0.0)
    return top(rows.withColumn("density_per_1k", density), 15, "density_per_1k", "hostname")


def e9_disk(t: DataFrame) -> DataFrame:
    rows = _newest(_of(t, SNAPSHOT).where("sys_disk_used_percent is not null"))
    return top(rows.select("hostname", to_float("sys_disk_used_percent").alias("used_pct"), to_float("sys_disk_free_gb").alias("free_gb")), 15, "used_pct", "hostname")


def e10_endpoints_per_rule(t: DataFrame) -> DataFrame:
    rows = _of(t, MATCH).where("rule_id is not null and hostname is not null")
    return top(rows.groupBy("rule_id").agg(F.countDistinct("hostname").alias("hosts")), 10, "hosts", "rule_id")


def e11_load_share(t: DataFrame) -> DataFrame:
    rows = _of(t, SNAPSHOT).where("sys_cpu_percent is not null and proc_cpu_percent is not null and hostname is not null")
    out = rows.groupBy("hostname").agg(_mean(to_float("sys_cpu_percent"), "avg_system_cpu"), _mean(to_float("proc_cpu_percent"), "avg_scanner_cpu"), F.max(to_float("proc_cpu_percent")).alias("peak_scanner_cpu"))
    return top(out, 15, "avg_scanner_cpu", "hostname")


def e12_hot_hosts(t: DataFrame) -> DataFrame:
    rows = _of(t, MATCH).where("hostname is not null")
    out = rows.groupBy("hostname").agg(F.sum(to_integer("match_count")).alias("hits"), latest("ipAddress", "_time", "data").alias("ip_address"))
    return top(out, 12, "hits", "hostname")


def e13_initiated(t: DataFrame) -> DataFrame:
    return _of(t, PERFORMANCE).where(contains("message", STARTED, False)).agg(F.countDistinct("hostname").alias("scanned_hosts"))


def e14_over_time(t: DataFrame) -> DataFrame:
    rows = _of(t, MATCH).where("level is not null")
    return rows.groupBy("level", bin_time("_time", "10 minutes").alias("bin")).agg(F.sum(to_integer("match_count")).alias("hits")).orderBy("bin", "level")


def e15_compilation(t: DataFrame) -> DataFrame:
    rows = _newest(_of(t, SUMMARY).where("valid_rules_compiled is not null"))
    return top(rows.select("hostname", to_integer("valid_rules_compiled").alias("valid_rules"), to_integer("failed_rules_skipped").alias("failed_rules")), 15, "failed_rules", "hostname")


def e16_scopes(t: DataFrame) -> DataFrame:
    rows = _of(t, MATCH).where("match_scope is not null")
    return top(rows.groupBy("match_scope", "rule_id").agg(F.count("*").alias("findings"), F.countDistinct("hostname").alias("hosts")), 20, "findings", "match_scope", "rule_id")


def e17_eta(t: DataFrame) -> DataFrame:
    rows = _newest(_of(t, STATISTICS, ESTIMATES))
    out = rows.select("hostname", F.round(divide(to_float("eta_seconds"), F.lit(60.0)), 6).alias("eta_min"), to_integer("files_remaining").alias("remaining"), to_float("current_rate_files_per_sec").alias("rate_fps"))
    return top(out, 15, "eta_min", "hostname")


def e18_progress(t: DataFrame) -> DataFrame:
    rows = _of(t, STATISTICS, PROGRESS).withColumns({"scanned": to_integer("files_scanned"), "skipped": to_integer("files_skipped")})
    out = rows.groupBy(bin_time("_time", "1 hour").alias("hour")).agg(_mean(to_float("scan_rate_files_per_sec"), "rate_fps"), latest("scanned", "_time", "data").alias("cum_scanned"), latest("skipped", "_time", "data").alias("cum_skipped"))
    return out.orderBy("hour")


def e19_rate(t: DataFrame) -> DataFrame:
    return _of(t, STATISTICS, PROGRESS).agg(_mean(to_float("scan_rate_files_per_sec"), "avg_rate"))


def _targets(t: DataFrame) -> DataFrame:
    """The newest completion of each host and target."""
    rows = t.where(F.col("message").contains(FINISHED) & F.col("data").isNotNull()).withColumn("target", json_scalar("data", "$.target"))
    return _newest(rows, "hostname", "target").select("hostname", "target", to_integer(json_scalar("data", "$.files_found")).alias("files_found"), to_float(json_scalar("data", "$.scan_time_seconds")).alias("secs"))


def e20_scan_minutes(t: DataFrame) -> DataFrame:
    each = _targets(t).groupBy("hostname").agg(F.sum("secs").alias("s"))
    return each.agg(*(f("s").alias(n) for f, n in ((F.avg, "a"), (F.max, "b"), (F.min, "c")))).select(*((F.col(c) / 60).cast("bigint").alias(n) for c, n in (("a", "avg_minutes"), ("b", "max_minutes"), ("c", "min_minutes"))))


def e21_disk_io(t: DataFrame) -> DataFrame:
    rows = _of(t, SNAPSHOT).where("hostname is not null and proc_io_read_mb is not null")
    out = rows.groupBy("hostname").agg(F.max(to_float("proc_io_read_mb")).alias("read_mb"), F.max(to_float("proc_io_write_mb")).alias("write_mb"))
    return top(out, 15, "read_mb", "hostname")


def e22_memory_growth(t: DataFrame) -> DataFrame:
    rows = _of(t, SNAPSHOT).where("hostname is not null and proc_memory_mb is not null")
    return rows.groupBy(bin_time("_time", "5 minutes").alias("bin"), "hostname").agg(_mean(to_float("proc_memory_mb"), "avg_mb"), F.max(to_float("proc_memory_mb")).alias("max_mb"))


def e23_threads(t: DataFrame) -> DataFrame:
    rows = _of(t, SNAPSHOT).where("hostname is not null and proc_thread_count is not null")
    return rows.groupBy(bin_time("_time", "5 minutes").alias("bin"), "hostname").agg(F.max(to_integer("proc_thread_count")).alias("threads"), F.max(to_integer("proc_file_descriptors")).alias("descriptors"))


def e24_volume(t: DataFrame) -> DataFrame:
    return top(_targets(t).groupBy("hostname").agg(F.sum("files_found").alias("files"), F.count("*").alias("targets")), 10, "files", "hostname")


def _strings(t: DataFrame) -> DataFrame:
    rows = _of(t, MATCH).where("strings is not null")
    return rows.withColumn("s", F.explode(F.from_json("strings", "array<string>")))


def e25_files_by_string(t: DataFrame) -> DataFrame:
    """The inner side has five rows; Spark broadcasts it by its limit."""
    five = top(_of(t, MATCH).where("file_name is not null").groupBy("file_name").agg(F.sum(to_integer("match_count")).alias("hits")), 5, "hits", "file_name")
    return _strings(t).where("file_name is not null and s is not null").groupBy("file_name", F.col("s").alias("string")).agg(F.count("*").alias("string_hits")).join(five.select("file_name", F.col("hits").alias("total_hits")), "file_name")


def e26_top_strings(t: DataFrame) -> DataFrame:
    out = _strings(t).where("s is not null").groupBy(F.col("s").alias("string")).agg(F.count("*").alias("hits"), F.countDistinct("rule_id").alias("rules"), F.countDistinct("hostname").alias("hosts"))
    return top(out, 20, "hits", "string")


def e27_top_rules(t: DataFrame) -> DataFrame:
    return top(_of(t, MATCH).where("rule_id is not null").groupBy("rule_id").agg(F.sum(to_integer("match_count")).alias("hits")), 15, "hits", "rule_id")


def e28_truncated(t: DataFrame) -> DataFrame:
    rows = _of(t, MATCH).where("truncated = 'true'")
    n = to_integer("match_count")
    out = rows.groupBy("rule_id").agg(F.count("*").alias("findings"), F.sum(n).alias("hits"), F.max(n).alias("most"), F.countDistinct("file_name").alias("files"))
    return top(out, 15, "hits", "rule_id")


def _workers(t: DataFrame) -> DataFrame:
    rows = _of(t, PERFORMANCE).where("worker_id is not null")
    return rows.groupBy("worker_id").agg(F.sum(to_float("files_processed")).alias("files"), _mean(to_float("avg_processing_time_ms"), "avg_ms"), _mean(to_float("error_rate_percent"), "avg_error"))


def e29_workers(t: DataFrame) -> DataFrame:
    out = _workers(t).select("worker_id", F.round(F.col("files") / 1e6, 9).alias("files_m"), "avg_ms", "avg_error")
    return top(out, 10, "files_m", "worker_id")


def e30_worker_errors(t: DataFrame) -> DataFrame:
    return _workers(t).select("worker_id", "avg_ms", "avg_error")
