"""Registered queries of the panels and operators over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .operators.alerts import alert_count_last_hour, build_alerts, cap_alerts, file_alert_events, resource_alerts, rollup_alerts
from .operators.findings import detection_breakdown, evidence_unique, file_identity, findings, match_events, rule_report, to_v3
from .operators.lifecycle import delivery_shortfall, final_metrics, final_report, heartbeat_gaps, latest_scan_state, time_estimates, verify_host, worker_summary
from .operators.maintenance import classify, filter_recent, gate, group_shards_by_scan, inventory, newest_ms, parse_names, parse_shard, plan, scan_rule_summary, scan_stats, select_legacy, select_rotated, shard_suffix, stale_scan_ids, summary_plan, target_name, terminal_map
from .operators.scan import scan_hits
from .operators.scope import classify_scope, dedupe_real_path, scope_filter, skip_breakdown, target_coverage, target_stats
from .operators.telemetry import BLOCKS, efficiency_metrics, parse_telemetry, performance_metrics, resource_summary, resource_trends, throttle_reports
from .plans import findings as pf
from .plans import lifecycle as pl
from .plans import recipes as pr
from .plans import telemetry as pt
from .table_queries import register as register_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# --- lifecycle ------------------------------------------------------------------------------

S = f"WITH s AS ({fx.duck(fx.SCANS, 'events')}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY event_timestamp_ms DESC, event_id DESC) AS rn FROM s) WHERE rn = 1), d AS (SELECT * FROM l WHERE status = 'completed'), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY event_timestamp_ms DESC, event_id DESC) AS rn FROM s WHERE status = 'completed') WHERE rn = 1) "
_DAY = "make_timestamp((event_timestamp_ms // 86400000) * 86400000000)"


def _on_scans(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(fx.scans(spark, sf))


for _name, _f, _sql in (
    ("q15_active_scans", pl.q15_active, "SELECT hostname, scan_id, status, files_scanned, detections, throttle_mode, event_timestamp_ms FROM l WHERE status IN ('running', 'initiated')"),
    ("q16_cancelled_scans", pl.q16_cancelled, "SELECT hostname, scan_id, files_scanned, detections, total_paused_secs, message FROM s WHERE status = 'cancelled' ORDER BY event_timestamp_ms DESC, event_id DESC LIMIT 50"),
    ("q17_clean_scans", pl.q17_clean, "SELECT CASE WHEN detections > 0 THEN 'With matches' ELSE 'Clean' END AS result, count(*) AS scans FROM d GROUP BY 1"),
    ("q18_coverage_gaps", pl.q18_coverage_gaps, "SELECT hostname, os_type, count(*) AS scans FROM l GROUP BY 1, 2 HAVING count(*) FILTER (status = 'completed') = 0"),
    ("q19_distinct_hosts", pl.q19_distinct_hosts, "SELECT count(DISTINCT hostname) AS hosts FROM s"),
    ("q20_failed_rule_trend", pl.q20_failed_rule_trend, f"SELECT {_DAY} AS day, CAST(sum(failed_rules) AS BIGINT) AS failed_rules FROM l GROUP BY 1"),
    ("q21_files_by_os", pl.q21_files_by_os, "SELECT os_type, CAST(sum(files_scanned) AS BIGINT) AS files FROM l GROUP BY 1"),
    ("q22_completed_files_by_os", pl.q22_completed_files_by_os, "SELECT os_type, CAST(sum(files_scanned) AS BIGINT) AS files FROM d GROUP BY 1"),
    ("q23_started_completed", pl.q23_started_completed, "SELECT hostname, count(*) AS started, count(*) FILTER (status = 'completed') AS completed, count(*) - count(*) FILTER (status = 'completed') AS gap FROM l GROUP BY 1"),
    ("q24_pack_failures", pl.q24_pack_failures, "SELECT hostname, CAST(sum(failed_rules) AS BIGINT) AS failed_rules FROM l WHERE failed_rules > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q25_completions", pl.q25_completions, f"SELECT {_DAY} AS day, count(*) AS scans FROM d GROUP BY 1"),
    ("q26_duration", pl.q26_duration, "SELECT hostname, round(avg(elapsed_secs), 6) AS avg_secs, CAST(sum(files_scanned) AS BIGINT) AS files FROM c GROUP BY 1"),
    ("q27_rate_leaders", pl.q27_rate_leaders, "SELECT hostname, round(avg(scan_rate_fps), 6) AS avg_fps FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q28_scans_by_os", pl.q28_by_os, "SELECT os_type, count(*) AS scans FROM l GROUP BY 1"),
    ("q29_scans_by_status", pl.q29_by_status, "SELECT status, count(*) AS scans FROM l GROUP BY 1"),
    ("q30_signal_density", pl.q30_signal_density, "SELECT hostname, round(1000 * sum(detections) / sum(files_scanned), 6) AS per_1k FROM d WHERE files_scanned > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q31_slowest_scans", pl.q31_slowest, "SELECT hostname, scan_id, elapsed_secs, files_scanned FROM d ORDER BY elapsed_secs DESC, hostname, scan_id LIMIT 20"),
    ("q32_throttle_modes", pl.q32_throttle_modes, "SELECT throttle_mode, count(*) AS scans FROM l GROUP BY 1"),
    ("q33_throttle_overhead", pl.q33_throttle_overhead, "SELECT hostname, round(avg(100 * (total_paused_secs / elapsed_secs)), 6) AS paused_pct FROM d WHERE elapsed_secs > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q34_total_files", pl.q34_total_files, "SELECT CAST(sum(files_scanned) AS BIGINT) AS files FROM s"),
    ("q35_paused", pl.q35_paused, "SELECT hostname, round(sum(total_paused_secs), 6) AS paused_secs FROM c GROUP BY 1"),
    ("q36_total_scans", pl.q36_total_scans, "SELECT count(DISTINCT scan_id) AS scans FROM s"),
    ("q37_rules_per_scan", pl.q37_rules_per_scan, "SELECT scan_id, hostname, valid_rules, failed_rules, valid_rules + failed_rules AS total_rules FROM d ORDER BY failed_rules DESC, scan_id LIMIT 20"),
    ("d13_rows_per_scan", pr.d13_rows_per_scan, "SELECT scan_id, count(*) AS n FROM s GROUP BY 1"),
    ("d15_rows_by_date", pr.d15_rows_by_date, f"SELECT strftime({_DAY}, '%Y%m%d') AS scan_date, count(*) AS n FROM s GROUP BY 1"),
    ("d19_host_history", lambda s: pr.d19_host_history(s, "host_7"), "SELECT event_timestamp_ms, scan_id, status, files_scanned, detections FROM s WHERE hostname = 'host_7'"),
    ("d18_target_rows", lambda s: pr.d18_target_rows(s, "scan_7"), "SELECT count(*) AS n FROM s WHERE scan_id = 'scan_7'"),
    ("d16_latest_ingested", lambda s: pr.d16_latest_ingested(s, "event_timestamp_ms").select("event_id", "scan_id", "status"), "SELECT event_id, scan_id, status FROM s ORDER BY event_timestamp_ms DESC, event_id DESC LIMIT 10"),
):
    add(_name, _on_scans(_f), S + _sql)

add("q38_compaction_runs", lambda spark, sf: pl.q38_compaction_runs(fx.runs(spark, sf)), f"WITH r AS ({fx.duck(fx.RUNS, 'orders')}) SELECT make_timestamp(run_ts_ms * 1000) AS run_time, status, consolidated_count, failed_count, failed_scan_ids, error_message FROM r ORDER BY run_ts_ms DESC, status, consolidated_count, failed_count, failed_scan_ids LIMIT 20")

A = f"WITH a AS (SELECT * FROM ({fx.duck(fx.ALERTS, 'events', "event_type = 'error'")}) WHERE contains(alert_name, 'YARA Match')) "
for _name, _f, _sql in (
    ("q39_alerting_rules", pl.q39_alerting_rules, "SELECT alert_name, count(*) AS alerts FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q40_alert_severity", pl.q40_alert_severity, "SELECT severity, count(*) AS alerts FROM a GROUP BY 1"),
    ("q41_alert_volume", pl.q41_alert_volume, "SELECT CAST(date_trunc('day', _time) AS TIMESTAMP) AS day, count(*) AS alerts FROM a GROUP BY 1"),
):
    add(_name, lambda spark, sf, f=_f: f(fx.alerts(spark, sf)), A + _sql)

# --- findings -------------------------------------------------------------------------------


def _count(text: str, nocase: bool) -> str:
    c, p = ("lower(content)", text.lower()) if nocase else ("content", text)
    return f"((length({c}) - length(replace({c}, '{p}', ''))) // {len(p)})"


_PER_RULE = " UNION ALL ".join(
    f"SELECT scan_id, hostname, os_type, path, content, event_timestamp_ms, '{r.rule}' AS rule, '{r.severity}' AS sev, {['low', 'medium', 'high', 'critical'].index(r.severity) + 1} AS rank, {' + '.join(_count(p.pattern, p.nocase) for p in r.strings)} AS n FROM corpus WHERE {' AND '.join(f'{_count(p.pattern, p.nocase)} > 0' for p in r.strings)}" for r in fx.RULES
)
F_SQL = f"""WITH corpus AS ({fx.duck(fx.CORPUS, 'documents')}), r AS ({_PER_RULE}), f AS (
  SELECT scan_id, hostname, os_type, path AS filename, strlen(content) AS file_size, sha256(content) AS file_sha256, event_timestamp_ms, CASE max(rank) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity,
    count(*) AS rule_count, CAST(sum(n) AS BIGINT) AS match_total
  FROM r GROUP BY ALL
) """
F_SQL = F_SQL.replace("FROM r GROUP BY ALL", "FROM r GROUP BY scan_id, hostname, os_type, path, content, event_timestamp_ms")


def _on_findings(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(fx.findings(spark, sf))


for _name, _f, _sql in (
    ("q2_by_os", pf.q2_by_os, "SELECT os_type, CAST(sum(match_total) AS BIGINT) AS hits, count(DISTINCT hostname) AS hosts FROM f GROUP BY 1"),
    ("q3_distinct_rules", pf.q3_distinct_rules, "SELECT count(DISTINCT rule) AS rules FROM r"),
    ("q4_endpoints_per_rule", pf.q4_endpoints_per_rule, "SELECT rule, count(DISTINCT hostname) AS hosts FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q5_triage_queue", lambda f: pf.q5_triage_queue(f).drop("rule_offsets"), "SELECT make_timestamp(f.event_timestamp_ms * 1000) AS scan_time, f.hostname, f.os_type, rule, filename, file_size, CAST(n AS BIGINT) AS rule_hits, false AS truncated, file_sha256 FROM f JOIN r ON f.filename = r.path WHERE severity = 'High' ORDER BY f.event_timestamp_ms DESC, f.hostname, filename, rule LIMIT 25"),
    ("q6_hot_hosts", pf.q6_hot_hosts, "SELECT hostname, CAST(sum(match_total) AS BIGINT) AS hits FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q7_largest_files", pf.q7_largest_files, "SELECT path AS filename, rule, hostname, max(strlen(content)) AS bytes, CAST(sum(n) AS BIGINT) AS hits FROM r GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 20"),
    ("q8_hit_buckets", pf.q8_hit_buckets, "SELECT CASE WHEN n < 2 THEN '01: 1 hit' WHEN n < 5 THEN '02: 2-4 hits' WHEN n < 20 THEN '03: 5-19 hits' WHEN n < 100 THEN '04: 20-99 hits' ELSE '05: >=100 hits' END AS hit_bucket, count(*) AS findings FROM r GROUP BY 1"),
    ("q9_matches_over_time", pf.q9_over_time, "SELECT make_timestamp((event_timestamp_ms // 3600000) * 3600000000) AS hour, CAST(sum(match_total) AS BIGINT) AS hits FROM f GROUP BY 1"),
    ("q10_severity_split", pf.q10_severity_split, "SELECT severity, CAST(sum(match_total) AS BIGINT) AS hits FROM f GROUP BY 1"),
    ("q11_top_files", pf.q11_top_files, "SELECT filename, file_sha256, CAST(sum(match_total) AS BIGINT) AS hits FROM f GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"),
    ("q12_top_rules", pf.q12_top_rules, "SELECT rule, CAST(sum(n) AS BIGINT) AS hits FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("q13_total_matches", pf.q13_total, "SELECT CAST(sum(match_total) AS BIGINT) AS hits FROM f"),
    ("q14_unique_files_per_rule", pf.q14_unique_files_per_rule, "SELECT rule, count(DISTINCT sha256(content)) AS unique_files, CAST(sum(n) AS BIGINT) AS hits FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("d9_scan_totals", pr.d9_scan_totals, "SELECT scan_id, count(*) AS files, CAST(sum(rule_count) AS BIGINT) AS pairs, CAST(sum(match_total) AS BIGINT) AS hits FROM f GROUP BY 1"),
    ("d11_rules_per_scan", pr.d11_rules_per_scan, "SELECT scan_id, hostname, rule, count(*) AS files FROM r GROUP BY 1, 2, 3"),
    ("d14_host_matches", lambda f: pr.d14_host_matches(pf.deduped(f), "src3"), "SELECT scan_id, filename, severity, match_total, event_timestamp_ms FROM f WHERE hostname = 'src3' ORDER BY event_timestamp_ms DESC, filename LIMIT 20"),
):
    add(_name, _on_findings(_f), F_SQL + _sql)

add(
    "q1_hotspot_folders",
    lambda spark, sf: pf.q1_hotspot_folders(fx.findings(spark, sf), fx.folder_scans(spark, sf)),
    F_SQL + ", h AS (SELECT 'scan_' || source AS scan_id, '/data/' || (min(doc_id) % 5) AS folder FROM documents GROUP BY source) SELECT folder, CAST(sum(match_total) AS BIGINT) AS hits, count(DISTINCT file_sha256) AS unique_files FROM f JOIN h USING (scan_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)

# --- telemetry ------------------------------------------------------------------------------


def _block_sql() -> str:
    """The parse in DuckDB: each block's columns by JSON path, in the first block that has them."""
    when = {"match": "type = 'yara_match'", "performance": "type = 'performance'", "progress": "type = 'statistics' AND contains(message, 'Scan Progress')", "estimates": "type = 'statistics' AND contains(message, 'Time Estimates')", "summary": "type = 'statistics_summary'", "snapshot": "type = 'system_resource_snapshot'"}
    out: dict[str, list[str]] = {}
    for block, columns in BLOCKS.items():
        for name, path in columns.items():
            out.setdefault(name, []).append(f"WHEN {when[block]} THEN json_extract_string(data, '$.{path}')")
    out["hostname"].append("ELSE hostname")
    return "SELECT type, \"ipAddress\", scan_id, level, message, data, _time, " + ", ".join(f"CASE {' '.join(v)} END AS {n}" for n, v in out.items()) + " FROM raw"


T = f"WITH raw AS ({fx.duck(fx.TELEMETRY, 'events')}), t AS ({_block_sql()}), m AS (SELECT *, CAST(match_count AS BIGINT) AS n FROM t WHERE type = 'yara_match'), g AS (SELECT * FROM t WHERE type = 'statistics' AND contains(message, 'Scan Progress')), x AS (SELECT * FROM t WHERE type = 'system_resource_snapshot'), w AS (SELECT * FROM t WHERE type = 'performance' AND worker_id IS NOT NULL), y AS (SELECT * FROM (SELECT hostname, json_extract_string(data, '$.target') AS target, CAST(json_extract_string(data, '$.files_found') AS BIGINT) AS files_found, CAST(json_extract_string(data, '$.scan_time_seconds') AS DOUBLE) AS secs, row_number() OVER (PARTITION BY hostname, json_extract_string(data, '$.target') ORDER BY _time DESC, data DESC) AS rn FROM t WHERE contains(message, 'Target scan completed:')) WHERE rn = 1) "


def _first(table: str, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY _time DESC, data DESC) AS rn FROM {table} WHERE hostname IS NOT NULL AND {where}) WHERE rn = 1)"


_W = "a AS (SELECT hostname AS host, max(_time) AS st FROM t WHERE type = 'performance' AND contains(lower(message), 'worker thread startup completed') GROUP BY 1), b AS (SELECT a.host, a.st, min(t._time) AS en FROM a JOIN t ON t.hostname = a.host WHERE contains(lower(t.message), 'target scan completed:') AND t._time >= a.st GROUP BY 1, 2) "


def _window_sql(present: str, value: str, name: str) -> str:
    return f", {_W} SELECT CAST(trunc(avg(v)) AS BIGINT) AS {name} FROM (SELECT host, avg(CAST({value} AS DOUBLE)) AS v FROM x JOIN b ON x.hostname = b.host WHERE x._time BETWEEN st AND en AND {present} IS NOT NULL GROUP BY 1)"


def _bin(minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTE, _time)"


def _on_telemetry(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(parse_telemetry(fx.telemetry_raw(spark, sf)))


for _name, _f, _sql in (
    ("p_parse_telemetry", lambda t: t, "SELECT * FROM t"),
    ("e1_fleet_inventory", pt.e1_fleet_inventory, f"SELECT platform, yara_version, python_version, count(DISTINCT hostname) AS hosts FROM {_first('t', "type = 'statistics_summary' AND platform IS NOT NULL")} GROUP BY 1, 2, 3"),
    ("e2_process_memory", pt.e2_process_memory, _window_sql("sys_memory_used_percent", "proc_memory_mb", "avg_proc_mem_mb")),
    ("e3_process_cpu", pt.e3_process_cpu, _window_sql("sys_cpu_percent", "proc_cpu_percent", "avg_proc_cpu_percent")),
    ("e4_system_cpu", pt.e4_system_cpu, _window_sql("sys_cpu_percent", "sys_cpu_percent", "avg_sys_cpu_percent")),
    ("e5_system_memory", pt.e5_system_memory, _window_sql("sys_memory_used_percent", "sys_memory_used_percent", "avg_sys_mem_percent")),
    ("e6_capacity", pt.e6_capacity, f", h AS (SELECT {_bin(60)} AS hour, 'Workers' AS metric, avg(CAST(active_workers AS BIGINT)) AS value FROM g GROUP BY 1 UNION ALL SELECT {_bin(60)}, 'Queue', avg(CAST(queue_size AS BIGINT)) FROM g GROUP BY 1) SELECT hour, metric, round(value, 6) AS value, CASE WHEN max(value) OVER (PARTITION BY metric) = 0 THEN 0.0 ELSE round(100 * (value / max(value) OVER (PARTITION BY metric)), 6) END AS value_index FROM h"),
    ("e7_completed_scans", pt.e7_completed, "SELECT count(DISTINCT hostname) AS scan_completed FROM t WHERE contains(message, 'Target scan completed:')"),
    ("e8_density", pt.e8_density, f"SELECT hostname, CAST(files_scanned AS DOUBLE) AS scanned, CAST(total_detections AS DOUBLE) AS dets, CASE WHEN CAST(files_scanned AS DOUBLE) > 0 THEN round(CAST(total_detections AS DOUBLE) / CAST(files_scanned AS DOUBLE) * 1000, 6) ELSE 0.0 END AS density_per_1k FROM {_first('g')} ORDER BY 4 DESC, 1 LIMIT 15"),
    ("e9_disk_headroom", pt.e9_disk, f"SELECT hostname, CAST(sys_disk_used_percent AS DOUBLE) AS used_pct, CAST(sys_disk_free_gb AS DOUBLE) AS free_gb FROM {_first('x')} ORDER BY 2 DESC, 1 LIMIT 15"),
    ("e10_endpoints_per_rule", pt.e10_endpoints_per_rule, "SELECT rule_id, count(DISTINCT hostname) AS hosts FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    ("e11_load_share", pt.e11_load_share, "SELECT hostname, round(avg(CAST(sys_cpu_percent AS DOUBLE)), 6) AS avg_system_cpu, round(avg(CAST(proc_cpu_percent AS DOUBLE)), 6) AS avg_scanner_cpu, max(CAST(proc_cpu_percent AS DOUBLE)) AS peak_scanner_cpu FROM x GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15"),
    ("e12_hot_hosts", pt.e12_hot_hosts, "SELECT hostname, CAST(sum(n) AS BIGINT) AS hits, arg_max(\"ipAddress\", (_time, data)) AS ip_address FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"),
    ("e13_initiated_scans", pt.e13_initiated, "SELECT count(DISTINCT hostname) AS scanned_hosts FROM t WHERE type = 'performance' AND contains(lower(message), 'worker thread startup completed')"),
    ("e14_matches_over_time", pt.e14_over_time, f"SELECT level, {_bin(10)} AS bin, CAST(sum(n) AS BIGINT) AS hits FROM m GROUP BY 1, 2"),
    ("e15_compilation", pt.e15_compilation, f"SELECT hostname, CAST(valid_rules_compiled AS BIGINT) AS valid_rules, CAST(failed_rules_skipped AS BIGINT) AS failed_rules FROM {_first('t', "type = 'statistics_summary'")} ORDER BY 3 DESC, 1 LIMIT 15"),
    ("e16_scopes", pt.e16_scopes, "SELECT match_scope, rule_id, count(*) AS findings, count(DISTINCT hostname) AS hosts FROM m GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"),
    ("e17_eta", pt.e17_eta, f"SELECT hostname, round(CAST(eta_seconds AS DOUBLE) / 60, 6) AS eta_min, CAST(files_remaining AS BIGINT) AS remaining, CAST(current_rate_files_per_sec AS DOUBLE) AS rate_fps FROM {_first('t', "type = 'statistics' AND contains(message, 'Time Estimates')")} ORDER BY 2 DESC, 1 LIMIT 15"),
    ("e18_progress", pt.e18_progress, f"SELECT {_bin(60)} AS hour, round(avg(CAST(scan_rate_files_per_sec AS DOUBLE)), 6) AS rate_fps, arg_max(CAST(files_scanned AS BIGINT), (_time, data)) AS cum_scanned, arg_max(CAST(files_skipped AS BIGINT), (_time, data)) AS cum_skipped FROM g GROUP BY 1"),
    ("e19_scan_rate", pt.e19_rate, "SELECT round(avg(CAST(scan_rate_files_per_sec AS DOUBLE)), 6) AS avg_rate FROM g"),
    ("e20_scan_minutes", pt.e20_scan_minutes, "SELECT CAST(trunc(avg(s) / 60) AS BIGINT) AS avg_minutes, CAST(trunc(max(s) / 60) AS BIGINT) AS max_minutes, CAST(trunc(min(s) / 60) AS BIGINT) AS min_minutes FROM (SELECT hostname, sum(secs) AS s FROM y GROUP BY 1)"),
    ("e21_disk_io", pt.e21_disk_io, "SELECT hostname, max(CAST(proc_io_read_mb AS DOUBLE)) AS read_mb, max(CAST(proc_io_write_mb AS DOUBLE)) AS write_mb FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("e22_memory_growth", pt.e22_memory_growth, f"SELECT {_bin(5)} AS bin, hostname, round(avg(CAST(proc_memory_mb AS DOUBLE)), 6) AS avg_mb, max(CAST(proc_memory_mb AS DOUBLE)) AS max_mb FROM x GROUP BY 1, 2"),
    ("e23_threads", pt.e23_threads, f"SELECT {_bin(5)} AS bin, hostname, max(CAST(proc_thread_count AS BIGINT)) AS threads, max(CAST(proc_file_descriptors AS BIGINT)) AS descriptors FROM x GROUP BY 1, 2"),
    ("e24_volume", pt.e24_volume, "SELECT hostname, CAST(sum(files_found) AS BIGINT) AS files, count(*) AS targets FROM y GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    ("e25_files_by_string", pt.e25_files_by_string, ", five AS (SELECT file_name, CAST(sum(n) AS BIGINT) AS total_hits FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT file_name, string, count(*) AS string_hits, any_value(total_hits) AS total_hits FROM (SELECT file_name, unnest(from_json(strings, '[\"VARCHAR\"]')) AS string FROM m) JOIN five USING (file_name) GROUP BY 1, 2"),
    ("e26_top_strings", pt.e26_top_strings, "SELECT string, count(*) AS hits, count(DISTINCT rule_id) AS rules, count(DISTINCT hostname) AS hosts FROM (SELECT rule_id, hostname, unnest(from_json(strings, '[\"VARCHAR\"]')) AS string FROM m) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    ("e27_top_rules", pt.e27_top_rules, "SELECT rule_id, CAST(sum(n) AS BIGINT) AS hits FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    ("e28_truncated", pt.e28_truncated, "SELECT rule_id, count(*) AS findings, CAST(sum(n) AS BIGINT) AS hits, max(n) AS most, count(DISTINCT file_name) AS files FROM m WHERE truncated = 'true' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15"),
    ("e29_workers", pt.e29_workers, "SELECT worker_id, round(sum(CAST(files_processed AS DOUBLE)) / 1e6, 9) AS files_m, round(avg(CAST(avg_processing_time_ms AS DOUBLE)), 6) AS avg_ms, round(avg(CAST(error_rate_percent AS DOUBLE)), 6) AS avg_error FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    ("e30_worker_errors", pt.e30_worker_errors, "SELECT worker_id, round(avg(CAST(avg_processing_time_ms AS DOUBLE)), 6) AS avg_ms, round(avg(CAST(error_rate_percent AS DOUBLE)), 6) AS avg_error FROM w GROUP BY 1"),
    ("d1_top_hosts", pr.d1_top_hosts, "SELECT hostname, CAST(sum(n) AS BIGINT) AS hits FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
    ("d2_top_rules", pr.d2_top_rules, "SELECT rule_id, count(*) AS findings, count(DISTINCT hostname) AS hosts FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
    ("d3_files_of_rule", lambda t: pr.d3_files_of_rule(t, "rule_3"), "SELECT _time, hostname, file_name, match_count FROM m WHERE rule_id = 'rule_3'"),
    ("d4_never_completed", lambda t: pr.d4_never_completed(t.withColumn("scan_id", F.date_format("_time", "yyyyMMddHH")), "performance", ("performance", "statistics_summary")), "SELECT strftime(_time, '%Y%m%d%H') AS scan_id, hostname FROM t WHERE type IN ('statistics_summary', 'performance') GROUP BY 1, 2 HAVING count(DISTINCT type) = 1 AND any_value(type) = 'performance'"),
    ("d5_correlation", pr.d5_correlation, "SELECT _time, 'YARA Match: ' || rule_id || ' on ' || hostname AS alert_name, level AS severity, file_name, scan_id FROM m"),
    ("d6_finished", pr.d6_finished, "SELECT hostname, count(*) AS completions FROM t WHERE contains(message, 'Target scan completed:') GROUP BY 1"),
    ("d7_completions", lambda t: pr.d7_completions(t, "statistics_summary"), "SELECT _time, hostname, data FROM t WHERE type = 'statistics_summary' ORDER BY _time DESC, data LIMIT 20"),
    ("d8_parse_check", pr.d8_parse_check, "SELECT _time, hostname, rule_id, file_name, match_count FROM m ORDER BY _time DESC, data LIMIT 100"),
):
    add(_name, _on_telemetry(_f), T + _sql)

# --- scan, alerts, lifecycle, metrics, maintenance --------------------------------------------


def _findings_of(spark: SparkSession, sf: str) -> DataFrame:
    return findings(fx.corpus(spark, sf), fx.RULES)


add("f12_skip_breakdown", lambda spark, sf: skip_breakdown(classify_scope(fx.corpus(spark, sf))), "SELECT 'Skipped extension' AS reason, count(*) AS files FROM documents WHERE doc_id % 17 = 0 HAVING count(*) > 0")
add("f9_scope_filter", lambda spark, sf: scope_filter(fx.corpus(spark, sf)).select("path", "file_size"), f"WITH corpus AS ({fx.duck(fx.CORPUS, 'documents')}) SELECT path, strlen(content) AS file_size FROM corpus WHERE path NOT LIKE '%.iso'")
add("g1_scan_hits", lambda spark, sf: scan_hits(fx.corpus(spark, sf), fx.RULES).groupBy("rule", "string_id").agg(F.count("*").alias("hits")), f"WITH corpus AS ({fx.duck(fx.CORPUS, 'documents')}) " + " UNION ALL ".join(f"SELECT '{r.rule}' AS rule, '{p.id}' AS string_id, CAST(sum({_count(p.pattern, p.nocase)}) AS BIGINT) AS hits FROM corpus HAVING sum({_count(p.pattern, p.nocase)}) > 0" for r in fx.RULES for p in r.strings))
add("g6_findings", lambda spark, sf: _findings_of(spark, sf).select("path", "rule", "match_count", "severity", "truncated"), F_SQL + "SELECT path, rule, CAST(n AS BIGINT) AS match_count, sev AS severity, n > 50 AS truncated FROM r")
add("g10_file_rows", lambda spark, sf: fx.file_findings(spark, sf).select("scan_id", "hostname", "os_type", "filename", "file_size", "file_sha256", "severity", "match_total", "rule_count", "event_timestamp_ms"), F_SQL + "SELECT scan_id, hostname, os_type, filename, file_size, file_sha256, severity, match_total, rule_count, event_timestamp_ms FROM f")
add("g16_rule_rows", lambda spark, sf: to_v3(fx.file_findings(spark, sf)).select("filename", "rule", "match_count", "severity"), F_SQL + "SELECT path AS filename, rule, CAST(n AS BIGINT) AS match_count, upper(sev[1]) || sev[2:] AS severity FROM r")
add("g17_detection_breakdown", lambda spark, sf: detection_breakdown(_findings_of(spark, sf)), F_SQL + ", b AS (SELECT rule, count(*) AS detections FROM r GROUP BY 1) SELECT rule, detections, (SELECT CAST(sum(detections) AS BIGINT) FROM b) AS total, (SELECT count(*) FROM b) AS unique_rules FROM b ORDER BY 2 DESC, 1 LIMIT 10")
add("g18_evidence_unique", lambda spark, sf: evidence_unique(fx.file_findings(spark, sf)).select("file_sha256", "file_size", "copies"), F_SQL + "SELECT file_sha256, any_value(file_size) AS file_size, count(*) AS copies FROM f GROUP BY 1")
add("a1_alerts", lambda spark, sf: build_alerts(_findings_of(spark, sf)).select("alert_name", "severity", "ip"), F_SQL + "SELECT 'YARA Match: ' || rule || ' | ' || split_part(path, '/', 5) || ' (#' || substr(sha1(path), 1, 8) || ') | Host: ' || hostname AS alert_name, CASE sev WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' ELSE 'Low' END AS severity, '127.0.0.1' AS ip FROM r")
add("a5_alert_rollup", lambda spark, sf: rollup_alerts(cap_alerts(build_alerts(_findings_of(spark, sf)), 2)), F_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY path, rule, hostname) AS i FROM r) SELECT scan_id, hostname, rule, count(*) AS suppressed_files, CAST(sum(n) AS BIGINT) AS suppressed_hits FROM k WHERE i > 2 GROUP BY 1, 2, 3")
def _on_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """The same findings on six hosts of one scan, of which eight alerts are let through."""
    hosts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("h"), i.cast("string"))))
    return cap_alerts(build_alerts(_findings_of(spark, sf).withColumns({"scan_id": F.lit("s"), "path": F.concat_ws("/", "rule", F.substring("path", 1, 6)), "hostname": hosts})), 8)


add("a4_alert_ties", lambda spark, sf: _on_hosts(spark, sf).where("NOT suppressed").select("hostname", "path", "rule"), F_SQL + ", h AS (SELECT DISTINCT rule || '/' || path[1:6] AS path, rule, unnest(['h0', 'h1', 'h2', 'h3', 'h4', 'h5']) AS hostname FROM r) SELECT hostname, path, rule FROM h ORDER BY path, rule, hostname LIMIT 8")
add("m19_scan_rule_summary", lambda spark, sf: scan_rule_summary(fx.findings(spark, sf)), F_SQL + "SELECT scan_id, hostname, rule, max(event_timestamp_ms) AS event_timestamp_ms FROM r GROUP BY 1, 2, 3")
add("l4_heartbeat_gaps", _on_scans(lambda s: heartbeat_gaps(s).select("event_id", "scan_id", F.round("gap_secs", 3).alias("gap_secs"), "late")), S + "SELECT event_id, scan_id, round((event_timestamp_ms - lag(event_timestamp_ms) OVER w) / 1000, 3) AS gap_secs, coalesce((event_timestamp_ms - lag(event_timestamp_ms) OVER w) / 1000 > 600, false) AS late FROM s WHERE status = 'running' WINDOW w AS (PARTITION BY scan_id ORDER BY event_timestamp_ms)")
add("l5_final_metrics", _on_scans(lambda s: final_metrics(latest_scan_state(s)).select("scan_id", "detection_rate", "skip_rate", "path_deduplication_ratio")), S + "SELECT scan_id, CASE WHEN files_scanned > 0 THEN round(detections / files_scanned, 6) ELSE 0.0 END AS detection_rate, CASE WHEN files_scanned + files_skipped > 0 THEN round(files_skipped / (files_scanned + files_skipped), 6) ELSE 0.0 END AS skip_rate, CASE WHEN files_scanned > 0 THEN 1.0 ELSE 0.0 END AS path_deduplication_ratio FROM l".replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"))
add("l10_worker_summary", lambda spark, sf: worker_summary(fx.scans(spark, sf).select(F.col("hostname").alias("worker_id"), F.col("files_scanned").alias("files"), F.col("files_skipped").alias("ms"), F.col("detections").alias("errors"))), S + "SELECT hostname AS worker_id, CAST(sum(files_scanned) AS BIGINT) AS files, round(sum(files_skipped) / sum(files_scanned), 6) AS mean_ms, round(sum(detections) * 100 / sum(files_scanned), 6) AS error_pct FROM s GROUP BY 1")
add("p8_efficiency", _on_telemetry(lambda t: efficiency_metrics(t.where("type = 'system_resource_snapshot'")).select("hostname", "_time", "memory_efficiency", "cpu_efficiency", "io_intensity", "network_intensity")), T + "SELECT hostname, _time, 100 - CAST(sys_memory_used_percent AS DOUBLE) AS memory_efficiency, 100 - CAST(sys_cpu_percent AS DOUBLE) AS cpu_efficiency, round((CAST(proc_io_read_mb AS DOUBLE) + CAST(proc_io_write_mb AS DOUBLE)) / greatest(CAST(proc_memory_mb AS DOUBLE), 1.0), 6) AS io_intensity, round(CAST(net_total_mb AS DOUBLE) / greatest(CAST(proc_memory_mb AS DOUBLE), 1.0), 6) AS network_intensity FROM x")
add("p10_resource_summary", _on_telemetry(lambda t: resource_summary(t.where("type = 'system_resource_snapshot'"), ("hostname",)).select("hostname", "snapshots", "min_cpu", "max_cpu", "avg_cpu", "current_cpu", "max_memory_mb")), T + "SELECT hostname, count(*) AS snapshots, min(CAST(proc_cpu_percent AS DOUBLE)) AS min_cpu, max(CAST(proc_cpu_percent AS DOUBLE)) AS max_cpu, round(avg(CAST(proc_cpu_percent AS DOUBLE)), 6) AS avg_cpu, arg_max(CAST(proc_cpu_percent AS DOUBLE), _time) AS current_cpu, max(CAST(proc_memory_mb AS DOUBLE)) AS max_memory_mb FROM x GROUP BY 1")
add("p11_running_peaks", _on_telemetry(lambda t: performance_metrics(t.where("type = 'system_resource_snapshot'")).select("hostname", "_time", "peak_cpu", "peak_memory_mb")), T + "SELECT hostname, _time, max(CAST(proc_cpu_percent AS DOUBLE)) OVER w AS peak_cpu, max(CAST(proc_memory_mb AS DOUBLE)) OVER w AS peak_memory_mb FROM x WINDOW w AS (PARTITION BY hostname ORDER BY _time ROWS UNBOUNDED PRECEDING)")
add("a7_resource_alerts", _on_telemetry(lambda t: resource_alerts(t.where("type = 'system_resource_snapshot'"))), T + ", v AS (SELECT hostname, _time, 'cpu' AS resource, CAST(sys_cpu_percent AS DOUBLE) AS value, CAST(90 AS DOUBLE) AS \"limit\" FROM x UNION ALL SELECT hostname, _time, 'memory', CAST(sys_memory_used_percent AS DOUBLE), CAST(85 AS DOUBLE) FROM x UNION ALL SELECT hostname, _time, 'disk', CAST(sys_disk_used_percent AS DOUBLE), CAST(95 AS DOUBLE) FROM x) SELECT * FROM v WHERE value > \"limit\"")
add("a8_alerts_last_hour", lambda spark, sf: alert_count_last_hour(fx.alerts(spark, sf)).select("event_id", "alerts_last_hour"), f"WITH a AS ({fx.duck(fx.ALERTS, 'events', "event_type = 'error'")}) SELECT event_id, count(*) OVER (PARTITION BY hostname ORDER BY _time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS alerts_last_hour FROM a")

_N = (
    f"WITH c AS ({fx.duck_catalog()}), p AS (SELECT *, regexp_extract(name, '^sigscan_(matches|scans)', 1) AS kind, CAST(regexp_extract(name, '_v([0-9]+)_', 1) AS INTEGER) AS version, nullif(regexp_extract(name, '_[0-9a-f]{{6}}_(20[0-9][0-9](0[1-9]|1[0-2]))$', 1), '') AS month, "
    "nullif(regexp_extract(name, '_v[0-9]+_(.*?_[0-9a-f]{6})(_20[0-9]{4})?$', 1), '') AS host FROM c), n AS (SELECT *, host IS NULL AS scan_target, host IS NOT NULL AND month IS NULL AND kind = 'matches' AND version >= 4 AS overwrite, (2026 * 12 + 8) - (CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 5, 2) AS INTEGER)) AS age FROM p) "
)
_REASON = "CASE WHEN scan_target THEN 'scan_target' WHEN overwrite THEN 'overwrite' WHEN month IS NULL THEN 'not_rotated' WHEN age < 0 THEN 'future_month' WHEN age = 0 THEN 'current_month' WHEN age <= 6 THEN 'within_window' END"
for _name, _f, _sql in (
    ("m3_shards", lambda c: parse_shard(c).select("name", "kind", "version", "host", "month"), "SELECT name, kind, version, host, month FROM n WHERE NOT scan_target AND NOT overwrite"),
    ("m4_names", lambda c: parse_names(c).select("name", "kind", "version", "host", "month", "scan_target", "overwrite"), "SELECT name, kind, version, host, month, scan_target, overwrite FROM n"),
    ("m5_generations", lambda c: classify(c, 4).groupBy("generation").agg(F.count("*").alias("n")), "SELECT CASE WHEN version = 4 THEN 'current' WHEN version < 4 THEN 'legacy' ELSE 'newer' END AS generation, count(*) AS n FROM n GROUP BY 1"),
    ("m8_newest", lambda c: c.select("name", newest_ms(F.col("newest_endpoint_ms"), F.col("newest_ingest_ms"), 1700040000000).alias("newest")), "SELECT name, greatest(CASE WHEN s IS NOT NULL AND newest_endpoint_ms > s + 300000 THEN NULL ELSE newest_endpoint_ms END, s) AS newest FROM (SELECT *, CASE WHEN newest_ingest_ms > 1700040000000 + 300000 THEN NULL ELSE newest_ingest_ms END AS s FROM c)"),
    ("m23_retention", lambda c: select_rotated(c, 6, 2026, 8).select("name", "selected", "reason"), f"SELECT name, {_REASON} IS NULL AS selected, {_REASON} AS reason FROM n"),
    ("m28_inventory", lambda c: inventory(c, 4, 2026, 8).groupBy("state").agg(F.count("*").alias("n"), F.coalesce(F.max("age_months"), F.lit(-1)).alias("oldest")), "SELECT CASE WHEN scan_target THEN 'consolidated' WHEN overwrite THEN 'overwrite' WHEN month IS NOT NULL THEN 'rotated' WHEN EXISTS (SELECT 1 FROM n y WHERE regexp_matches(y.name, '_[0-9]{6}$') AND y.name[:-8] = n.name) THEN 'frozen' ELSE 'not_rotated' END AS state, count(*) AS n, coalesce(max(age), -1) AS oldest FROM n GROUP BY 1"),
    ("m1_suffixes", lambda c: c.select("custkey", shard_suffix("name").alias("suffix")), "SELECT custkey, substr(name, 1, 32) || '_' || substr(sha1(name), 1, 6) AS suffix FROM c"),
):
    add(_name, lambda spark, sf, f=_f: f(fx.catalog(spark, sf)), _N + _sql)


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    scans = fx.scans(spark, sf).withColumn("shard", F.concat("hostname", F.lit("_"), F.col("os_type")))
    stats = scan_stats(scans).join(scans.select("shard", "scan_id", "hostname").distinct(), ["shard", "scan_id"])
    return gate(stats, terminal_map(scans), _NOW)


_NOW = 1706745600000
add(
    "m10_gate",
    _gate,
    S + f", z AS (SELECT hostname || '_' || os_type AS shard, scan_id, max(event_timestamp_ms) AS ep FROM s GROUP BY 1, 2), u AS (SELECT scan_id, min(status) AS status FROM l GROUP BY 1), v AS (SELECT z.*, CASE WHEN status NOT IN ('completed', 'cancelled', 'failed') AND {_NOW} - ep < 86400000 AND {_NOW} - ep < 604800000 THEN 'host_not_terminal' WHEN {_NOW} - ep < 900000 THEN 'within_quiet_period' END AS reason FROM z JOIN u USING (scan_id)) SELECT scan_id, arg_min(reason, CASE WHEN reason IS NOT NULL THEN shard END) AS reason FROM v GROUP BY 1",
)


# --- more operators ---------------------------------------------------------------------------

_C = f"WITH corpus AS ({fx.duck(fx.CORPUS, 'documents')}) "


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    hosts = fx.corpus(spark, sf).select("hostname").distinct()
    return target_coverage(hosts.select("hostname", F.explode(F.array(F.concat(F.lit("/data/"), "hostname"), F.lit("/none"), F.lit("rel"))).alias("target")), fx.corpus(spark, sf))


add("f13_target_coverage", _targets, _C + ", t AS (SELECT hostname, unnest(['/data/' || hostname, '/none', 'rel']) AS target FROM (SELECT DISTINCT hostname FROM corpus)) SELECT t.hostname, target, count(path) AS files, CASE WHEN target = 'rel' THEN 'invalid' WHEN count(path) = 0 THEN 'empty' ELSE 'covered' END AS status FROM t LEFT JOIN corpus c ON c.hostname = t.hostname AND starts_with(path, target || '/') GROUP BY 1, 2")
add("f14_target_stats", lambda spark, sf: target_stats(fx.corpus(spark, sf).withColumn("target", F.col("os_type")).withColumn("scan_secs", F.lit(7.0))), _C + "SELECT hostname, os_type AS target, count(*) AS files_found, CAST(7 AS DOUBLE) AS scan_secs, round(count(*) / 7.0::DOUBLE, 2) AS files_per_second FROM corpus GROUP BY 1, 2")
add("f10_real_paths", lambda spark, sf: dedupe_real_path(fx.corpus(spark, sf).withColumn("real_path", F.sha2(F.col("content").cast("binary"), 256))).groupBy("hostname").agg(F.count("*").alias("files")), _C + "SELECT hostname, count(DISTINCT sha256(content)) AS files FROM corpus GROUP BY 1")
add("g12_file_identity", lambda spark, sf: file_identity(fx.corpus(spark, sf)).select("path", "file_size", "file_sha256"), _C + "SELECT path, strlen(content) AS file_size, sha256(content) AS file_sha256 FROM corpus")
_FIRST = "CASE rule WHEN 'Mit_License' THEN instr(content, 'MIT License') WHEN 'Email_Address' THEN instr(content, '@') WHEN 'Token_Nocase' THEN instr(lower(content), 'token') WHEN 'License_Nocase' THEN instr(lower(content), 'license') ELSE least(instr(lower(content), 'license'), instr(content, 'MIT')) END"
_LENGTH = "CASE rule WHEN 'Mit_License' THEN 11 WHEN 'Email_Address' THEN 1 WHEN 'Token_Nocase' THEN 5 WHEN 'License_Nocase' THEN 7 ELSE CASE WHEN instr(content, 'MIT') < instr(lower(content), 'license') THEN 3 ELSE 7 END END"
add(
    "g15_match_events",
    lambda spark, sf: match_events(_findings_of(spark, sf)).select("hostname", "level", *(F.get_json_object("data", f"$.{place}").alias(name) for name, place in (("filename", "filename"), ("rule", "rule"), ("match_count", "match_count"), ("offset", "offsets[0]"), ("string", "strings[0]"))), F.size(F.from_json(F.get_json_object("data", "$.offsets"), "array<long>")).cast("bigint").alias("offsets"), F.size(F.from_json(F.get_json_object("data", "$.match_ids"), "map<string,long>")).cast("bigint").alias("ids")),
    F_SQL + f"SELECT hostname, sev AS level, path AS filename, rule, CAST(n AS VARCHAR) AS match_count, CAST(strlen(left(content, {_FIRST} - 1)) AS VARCHAR) AS offset, substr(content, {_FIRST}, {_LENGTH}) AS string, CAST(least(n, 50) AS BIGINT) AS offsets, CAST(CASE rule WHEN 'License_And_Mit' THEN 2 ELSE 1 END AS BIGINT) AS ids FROM r",
)
add("g19_rule_report", lambda spark, sf: rule_report(_findings_of(spark, sf)).select("scan_id", "rule", "files", "hits", "dropped_lines"), F_SQL + "SELECT scan_id, rule, count(*) AS files, CAST(sum(n) AS BIGINT) AS hits, CAST(0 AS BIGINT) AS dropped_lines FROM r GROUP BY 1, 2")
add("a6_file_alert_events", lambda spark, sf: file_alert_events(_findings_of(spark, sf)).select("path", F.array_join("rules", ",").alias("rules"), "hits"), F_SQL + "SELECT path, string_agg(rule, ',' ORDER BY rule) AS rules, CAST(sum(n) AS BIGINT) AS hits FROM r GROUP BY path, scan_id")
add("l6_final_report", _on_scans(lambda s: final_report(latest_scan_state(s)).select("scan_id", "compile_success_pct", "efficiency")), S + "SELECT scan_id, round(round(valid_rules / (valid_rules + failed_rules), 12) * 100, 2) AS compile_success_pct, round(greatest(0.0, 100 - (CASE WHEN files_scanned + files_skipped > 0 THEN round(files_skipped / (files_scanned + files_skipped), 12) ELSE 0 END * 20 + round(failed_rules / (valid_rules + failed_rules), 12) * 30)), 2) AS efficiency FROM l")
add(
    "l7_delivery_shortfall",
    lambda spark, sf: delivery_shortfall(fx.scans(spark, sf).select("scan_id", F.col("os_type").alias("channel"), F.col("files_skipped").alias("n")), fx.scans(spark, sf).where("event_id % 3 = 0").select("scan_id", F.col("os_type").alias("channel"), F.col("files_skipped").alias("n"))).select("scan_id", "channel", "queued", "landed", "lost"),
    S + "SELECT scan_id, os_type AS channel, CAST(sum(files_skipped) AS BIGINT) AS queued, CAST(coalesce(sum(files_skipped) FILTER (event_id % 3 = 0), 0) AS BIGINT) AS landed, CAST(sum(files_skipped) - coalesce(sum(files_skipped) FILTER (event_id % 3 = 0), 0) AS BIGINT) AS lost FROM s GROUP BY 1, 2",
)
add(
    "l8_time_estimates",
    _on_scans(lambda s: time_estimates(s.select("event_id", "scan_id", F.col("files_scanned").alias("processed"), (F.col("files_scanned") + F.col("files_skipped")).alias("total"), "elapsed_secs", "event_timestamp_ms")).select("event_id", "rate", "files_remaining", (F.col("recent_rate") + F.lit(0.0)).alias("recent_rate"))),
    S + "SELECT event_id, CASE WHEN elapsed_secs > 0 THEN round(files_scanned / elapsed_secs, 6) ELSE 0.0 END AS rate, files_skipped AS files_remaining, CASE WHEN event_timestamp_ms > first_value(event_timestamp_ms) OVER w THEN round((files_scanned - first_value(files_scanned) OVER w) / ((event_timestamp_ms - first_value(event_timestamp_ms) OVER w) / 1000), 6) + CAST(0 AS DOUBLE) ELSE 0.0 END AS recent_rate FROM s WINDOW w AS (PARTITION BY scan_id ORDER BY event_timestamp_ms ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
)
add("l12_verify_host", _on_scans(lambda s: verify_host(s.select("event_id", "scan_id", "hostname", "event_timestamp_ms"), "host_5")), S + "SELECT event_id, scan_id, hostname, event_timestamp_ms FROM s WHERE hostname = 'host_5' ORDER BY event_timestamp_ms DESC, scan_id LIMIT 20")
add(
    "p9_resource_trends",
    _on_telemetry(lambda t: resource_trends(t.where("type = 'system_resource_snapshot'")).select("hostname", "_time", "cpu_trend", "memory_trend", "data_points", F.round("cpu_avg", 4).alias("cpu_avg"))),
    T + ", z AS (SELECT hostname, _time, CAST(sys_cpu_percent AS DOUBLE) AS c, CAST(sys_memory_used_percent AS DOUBLE) AS m FROM x), o AS (SELECT *, count(*) OVER w AS k, first_value(c) OVER w AS c0, first_value(m) OVER w AS m0, avg(c) OVER w AS ca FROM z WINDOW w AS (PARTITION BY hostname ORDER BY _time ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)) SELECT hostname, _time, CASE WHEN k < 2 THEN NULL WHEN k >= 5 AND (c - c0) / k > 2 THEN 'increasing' WHEN k >= 5 AND (c - c0) / k < -2 THEN 'decreasing' ELSE 'stable' END AS cpu_trend, CASE WHEN k < 2 THEN NULL WHEN k >= 5 AND (m - m0) / k > 5 THEN 'increasing' WHEN k >= 5 AND (m - m0) / k < -5 THEN 'decreasing' ELSE 'stable' END AS memory_trend, CASE WHEN k >= 2 THEN k ELSE 0 END AS data_points, CASE WHEN k >= 2 THEN round(round(ca, 6), 4) END AS cpu_avg FROM o",
)
add(
    "p12_throttled_reports",
    _on_telemetry(lambda t: throttle_reports(t.where("type = 'performance' AND worker_id IS NOT NULL"), 3600).select("hostname", "worker_id", "_time")),
    T.replace("WITH ", "WITH RECURSIVE ", 1) + ", kept AS (SELECT hostname, worker_id, min(_time) AS _time FROM w GROUP BY 1, 2 UNION ALL SELECT w.hostname, w.worker_id, min(w._time) FROM kept JOIN w ON w.hostname = kept.hostname AND w.worker_id = kept.worker_id AND w._time >= kept._time + INTERVAL 1 HOUR GROUP BY 1, 2) SELECT hostname, worker_id, _time FROM kept",
)
add("d10_unfinished_runs", lambda spark, sf: pr.d10_unfinished_runs(fx.runs(spark, sf).withColumn("status", F.when(F.col("status") == "crashed", "started").otherwise(F.col("status")))), f"WITH r AS (SELECT run_ts_ms, CASE status WHEN 'crashed' THEN 'started' ELSE status END AS status FROM ({fx.duck(fx.RUNS, 'orders')})), q AS (SELECT *, lead(status) OVER (ORDER BY run_ts_ms, status) AS following FROM r) SELECT run_ts_ms, status FROM q WHERE status = 'started' AND (following IS NULL OR following = 'started')")
add("d12_run_history", lambda spark, sf: pr.d12_cleanup_history(fx.runs(spark, sf).select("run_ts_ms", "status").distinct()), f"SELECT run_ts_ms, status, make_timestamp(run_ts_ms * 1000) AS run_time FROM (SELECT DISTINCT run_ts_ms, status FROM ({fx.duck(fx.RUNS, 'orders')})) ORDER BY run_ts_ms DESC, status LIMIT 20")
add("d17_v3_top_rules", lambda spark, sf: pr.d17_v3_top_rules(to_v3(fx.file_findings(spark, sf))), F_SQL + "SELECT rule, CAST(sum(n) AS BIGINT) AS hits FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
add("m2_targets", _on_scans(lambda s: s.select(target_name("matches", 4, "scan_id").alias("target")).distinct()), S + "SELECT DISTINCT 'sigscan_matches_v4_' || scan_id AS target FROM s")
add("m6_scan_stats", _on_scans(lambda s: scan_stats(s.withColumn("shard", F.col("hostname"))).select("shard", "scan_id", "rows", "newest_endpoint_ms")), S + "SELECT hostname AS shard, scan_id, count(*) AS rows, max(event_timestamp_ms) AS newest_endpoint_ms FROM s GROUP BY 1, 2")
add("m9_terminals", _on_scans(lambda s: terminal_map(s)), S + "SELECT scan_id, hostname, status IN ('completed', 'cancelled', 'failed') AS terminal FROM (SELECT scan_id, hostname, arg_max(status, (event_timestamp_ms, status)) AS status FROM s GROUP BY 1, 2)")
add("m11_plan", _on_scans(lambda s: plan(s.groupBy("scan_id").agg(F.count("*").alias("source_rows"), F.count(F.when(F.col("event_id") % 97 > 0, 1)).alias("target_rows")), 70)), S + "SELECT scan_id, count(*) AS source_rows, count(*) FILTER (event_id % 97 > 0) AS target_rows, CASE WHEN count(*) > 70 THEN 'row_ceiling_exceeded' WHEN count(*) = count(*) FILTER (event_id % 97 > 0) THEN 'verified' ELSE 'count_mismatch' END AS state FROM s GROUP BY 1")
add("m20_summary_plan", _on_scans(lambda s: summary_plan(s.groupBy("scan_id").agg((F.max("event_id") % 2 == 0).alias("terminal"), F.max("event_timestamp_ms").alias("newest_ms"), F.count("*").alias("expected_rows"), F.count(F.when(F.col("event_id") % 3 == 0, 1)).alias("summary_rows")), _NOW).select("scan_id", "action")), S + f"SELECT scan_id, CASE WHEN NOT (max(event_id) % 2 = 0 OR {_NOW} - max(event_timestamp_ms) >= 86400000) THEN 'wait' WHEN count(*) FILTER (event_id % 3 = 0) = count(*) THEN 'skip' WHEN count(*) FILTER (event_id % 3 = 0) > 0 THEN 'fail' ELSE 'write' END AS action FROM s GROUP BY 1")
add("m24_recent_rail", lambda spark, sf: filter_recent(select_rotated(fx.catalog(spark, sf), 6, 2026, 8), 1700086400000 + 40 * 60000, 24).select("name", "selected", "reason"), _N + f", h AS (SELECT *, {_REASON} AS why, CASE WHEN newest_endpoint_ms IS NOT NULL AND newest_ingest_ms > 1700088800000 + 300000 THEN NULL ELSE newest_ingest_ms END AS srv FROM n), k AS (SELECT *, 1700088800000 - greatest(CASE WHEN srv IS NOT NULL AND newest_endpoint_ms > srv + 300000 THEN NULL ELSE newest_endpoint_ms END, srv) < 86400000 AS fresh FROM h) SELECT name, why IS NULL AND NOT fresh AS selected, CASE WHEN why IS NULL AND fresh THEN 'recently_written' ELSE why END AS reason FROM k")
add("m26_legacy", lambda spark, sf: select_legacy(fx.catalog(spark, sf), 5, 6, 2026, 8).select("name", "selected", "reason"), _N + f"SELECT name, CASE WHEN version = 5 THEN false ELSE {_REASON} IS NULL END AS selected, CASE WHEN version = 5 THEN 'current_schema' ELSE {_REASON} END AS reason FROM n")
add("m30_stale_scans", _on_scans(lambda s: stale_scan_ids(s, "host_3", "scan_3")), S + "SELECT DISTINCT scan_id FROM s WHERE hostname = 'host_3' AND scan_id <> 'scan_3'")
add("m31_shards_by_scan", _on_scans(lambda s: group_shards_by_scan(s.withColumn("shard", F.col("os_type")))), S + "SELECT scan_id, os_type AS shard, count(*) AS rows FROM s GROUP BY 1, 2")

register_tables(add, F_SQL, S, T, _N, _REASON)
ORACLE_SQL["t9_throttled_stream"] = ORACLE_SQL["p12_throttled_reports"]
