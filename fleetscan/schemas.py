"""Table shapes and fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One matched string in a rule pack.
STRING = "struct<id:string,pattern:string,kind:string,nocase:boolean,wide:boolean,ascii:boolean>"
RULESET = f"rule string, tags array<string>, meta map<string,string>, strings array<{STRING}>, condition string"
RULE_HIT = "struct<rule:string,match_count:bigint,offsets:array<string>,strings:array<string>,string_ids:array<struct<id:string,count:bigint>>,truncated:boolean,severity:string>"
#: One row for each matched file; ``rule`` and ``match_count`` are set on older rows only.
FINDINGS = f"scan_id string, hostname string, os_type string, filename string, file_size bigint, file_sha256 string, severity string, rule string, match_count bigint, match_total bigint, rule_count bigint, truncated boolean, event_timestamp_ms bigint, rules array<{RULE_HIT}>"
LIFECYCLE = "scan_id string, hostname string, os_type string, status string, scan_folder string, files_scanned bigint, files_skipped bigint, detections bigint, valid_rules bigint, failed_rules bigint, scan_rate_fps double, elapsed_secs double, total_paused_secs double, throttle_mode string, event_timestamp_ms bigint, message string"
TELEMETRY = "type string, hostname string, ipAddress string, scan_id string, level string, message string, data string, _time timestamp"
COMPACTION_RUNS = "run_ts_ms bigint, status string, consolidated_count bigint, failed_count bigint, failed_scan_ids string, reasons string, error_message string"
CLEANUP_RUNS = "run_ts_ms bigint, status string, dry_run boolean, rotated_months bigint, quiet_hours bigint, deleted_count bigint, deleted string, kept_count bigint, reasons string, error_message string"

#: States, severities and their order, type names, message marks.
TERMINAL = ("completed", "cancelled", "failed")
RUNNING = ("running", "initiated")
SEVERITY_ORDER = ("low", "medium", "high", "critical")
ALERT_LABELS = {"critical": "High", "high": "High", "medium": "Medium", "low": "Low", "info": "Low"}
MATCH, PERFORMANCE, STATISTICS = "yara_match", "performance", "statistics"
SUMMARY, SNAPSHOT = "statistics_summary", "system_resource_snapshot"
PROGRESS, ESTIMATES = "Scan Progress", "Time Estimates"
STARTED, FINISHED = "Worker thread startup completed", "Target scan completed:"
ALERT_MARK = "YARA Match"
#: What names of owned tables begin with.
PREFIX = "sigscan"


def schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def conform(df: DataFrame, text: str) -> DataFrame:
    """Exactly the schema's columns, absent ones null; a column that isn't in it raises."""
    want = schema(text)
    extra = set(df.columns) - set(want.names)
    if extra:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields))


def severity_rank(col: str):
    """low 1 to critical 4, anything else 0."""
    ranks = F.create_map(*(x for i, s in enumerate(SEVERITY_ORDER, 1) for x in (F.lit(s), F.lit(i))))
    return F.coalesce(F.try_element_at(ranks, F.lower(F.col(col))), F.lit(0))
