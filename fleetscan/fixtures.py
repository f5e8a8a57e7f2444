"""The engine's tables as views of the driver's tables.

Most columns are SQL expressions that Spark and DuckDB both have, so the comparison SQL is
built from the same text.  ``{ms}``, ``{k}`` and ``{ts}`` stand for what they spell
differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.findings import scan
from .operators.scan import Pattern, Rule, of_them
from .schemas import FINDINGS, conform

DUCK = {"ms": "(epoch_us(ts) // 1000)", "k": "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)", "ts": "ts"}
SPARK = {"ms": "unix_millis(CAST(ts AS TIMESTAMP))", "k": "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)", "ts": "CAST(ts AS TIMESTAMP)"}

_Q = "chr(92), '\"'"

SCANS = {
    "event_id": "event_id",
    "scan_id": "concat('scan_', user_id)",
    "hostname": "concat('host_', user_id % 20)",
    "os_type": "CASE user_id % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' ELSE 'macos' END",
    "status": "CASE event_type WHEN 'signup' THEN 'initiated' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'cancelled' END ELSE 'running' END",
    "scan_folder": "concat('/data/', user_id % 5)",
    "files_scanned": "CAST(floor(value) AS BIGINT)",
    "files_skipped": "event_id % 11",
    "detections": "event_id % 7",
    "valid_rules": "10 + event_id % 5",
    "failed_rules": "{k} % 5",
    "scan_rate_fps": "value / 10",
    "elapsed_secs": "CAST(event_id % 300 AS DOUBLE)",
    "total_paused_secs": "CAST(event_id % 60 AS DOUBLE)",
    "throttle_mode": "CASE event_id % 3 WHEN 0 THEN 'headroom' WHEN 1 THEN 'budget' ELSE 'none' END",
    "event_timestamp_ms": "{ms}",
    "message": "event_type",
}

_MATCH = f"concat('{{{{\"filename\":\"/data/', {{k}} % 13, '/f', event_id % 50, '.txt\",\"rule\":\"rule_', {{k}} % 9, '\",\"match_count\":', 1 + event_id % 20, ',\"offsets\":\"[', event_id % 100, ']\",\"strings\":\"[', {_Q}, 's', {{k}} % 7, {_Q}, ',', {_Q}, 's', event_id % 5, {_Q}, ']\",\"match_scope\":\"', CASE WHEN event_id % 8 = 0 THEN 'rule' ELSE 'string' END, '\",\"truncated\":', CASE WHEN {{k}} % 10 = 0 THEN 'true' ELSE 'false' END, '}}}}')"
_PROGRESS = "concat('{{\"files_scanned\":', event_id % 5000, ',\"files_skipped\":', event_id % 17, ',\"total_detections\":', {k}, ',\"queue_size\":', {k} % 40, ',\"scan_rate_files_per_sec\":', value, ',\"metrics\":{{\"active_workers\":', 1 + user_id % 4, ',\"cpu_percent\":', {k}, '}}}}')"
_ESTIMATES = "concat('{{\"eta_seconds\":', event_id % 7200, ',\"files_remaining\":', event_id % 9000, ',\"current_rate_files_per_sec\":', value, '}}')"
_TARGET = "concat('{{\"target\":\"t', user_id % 3, '\",\"files_found\":', event_id % 1000, ',\"scan_time_seconds\":', event_id % 900, ',\"files_per_second\":', value, '}}')"
_WORKER = "concat('{{\"worker_id\":\"w', {k} % 8, '\",\"files_processed\":', event_id % 5000, ',\"avg_processing_time_ms\":', value, ',\"error_rate_percent\":', {k} % 10, '}}')"
_SNAPSHOT = "concat('{{\"process\":{{\"cpu_percent\":', value, ',\"memory_mb\":', {k} * 10, ',\"io_read_mb\":', event_id % 500, ',\"io_write_mb\":', event_id % 300, ',\"thread_count\":', {k} % 32, ',\"file_descriptors\":', {k}, '}},\"system\":{{\"cpu_percent\":', {k} % 100, ',\"memory_used_percent\":', event_id % 100, ',\"disk_free_gb\":', user_id, ',\"disk_used_percent\":', event_id % 98, '}},\"network\":{{\"total_mb\":', user_id % 9, '}}}}')"
_SUMMARY = "concat('{{\"phase\":\"final\",\"system_info\":{{\"hostname\":\"host_', user_id % 20, '\",\"platform\":\"', CASE user_id % 3 WHEN 0 THEN 'Windows' WHEN 1 THEN 'Linux' ELSE 'Darwin' END, '\",\"python_version\":\"3.', 8 + user_id % 4, '\",\"yara_version\":\"4.', user_id % 2, '\",\"scan_targets\":[\"/a', user_id % 3, '\",\"/b\"]}},\"compilation_results\":{{\"valid_rules_compiled\":', 100 + {k}, ',\"failed_rules_skipped\":', event_id % 9, '}}}}')"

TELEMETRY = {
    "type": "CASE event_type WHEN 'view' THEN 'yara_match' WHEN 'click' THEN 'statistics' WHEN 'purchase' THEN 'statistics' WHEN 'signup' THEN 'performance' ELSE CASE WHEN event_id % 5 = 0 THEN 'statistics_summary' ELSE 'system_resource_snapshot' END END",
    "hostname": "concat('host_', user_id % 20)",
    "ipAddress": "concat('10.0.', user_id % 20, '.', event_id % 250)",
    "scan_id": "concat('scan_', user_id)",
    "level": "CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END",
    "message": "CASE event_type WHEN 'view' THEN 'match' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN concat('Scan Progress | ', event_id) ELSE concat('Time Estimates | ', event_id) END WHEN 'purchase' THEN concat('Target scan completed: t', user_id % 3) WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Worker thread startup completed' ELSE 'Worker Performance' END ELSE 'snapshot' END",
    "data": f"CASE event_type WHEN 'view' THEN {_MATCH} WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN {_PROGRESS} ELSE {_ESTIMATES} END WHEN 'purchase' THEN {_TARGET} WHEN 'signup' THEN {_WORKER} ELSE CASE WHEN event_id % 5 = 0 THEN {_SUMMARY} ELSE {_SNAPSHOT} END END",
    "_time": "{ts}",
}

ALERTS = {
    "event_id": "event_id",
    "alert_name": "CASE WHEN event_id % 2 = 0 THEN concat('YARA Match: rule_', {k} % 9, ' | f', event_id % 10) ELSE 'Other' END",
    "severity": "CASE user_id % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END",
    "hostname": "concat('host_', user_id % 20)",
    "_time": "{ts}",
}

RUNS = {
    "run_ts_ms": "{odate}",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial_failure' ELSE 'crashed' END",
    "consolidated_count": "o_orderkey % 10",
    "failed_count": "o_orderkey % 3",
    "failed_scan_ids": "concat('scan_', o_orderkey)",
    "error_message": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'lost' END",
}
_ODATE = {"duck": "(epoch_us(o_orderdate) // 1000)", "spark": "unix_millis(CAST(o_orderdate AS TIMESTAMP))"}

RULES = [
    Rule("Mit_License", (Pattern("Mit_License", "$a", "MIT License"),), of_them(["$a"]), "low"),
    Rule("Email_Address", (Pattern("Email_Address", "$a", "@"),), of_them(["$a"]), "high"),
    Rule("License_Nocase", (Pattern("License_Nocase", "$a", "license", nocase=True),), of_them(["$a"]), "medium"),
    Rule("Token_Nocase", (Pattern("Token_Nocase", "$a", "token", nocase=True),), of_them(["$a"]), "high"),
    Rule("License_And_Mit", (Pattern("License_And_Mit", "$a", "license", nocase=True), Pattern("License_And_Mit", "$b", "MIT")), of_them(["$a", "$b"], 2), "medium"),
]

CORPUS = {
    "scan_id": "concat('scan_', source)",
    "hostname": "source",
    "os_type": "CASE lang WHEN 'en' THEN 'windows' WHEN 'de' THEN 'linux' ELSE 'macos' END",
    "path": "concat('/data/', source, '/', lang, '/', doc_id, CASE WHEN doc_id % 17 = 0 THEN '.iso' WHEN doc_id % 13 = 0 THEN '.html' ELSE '.txt' END)",
    "content": "text",
    "event_timestamp_ms": "1704067200000 + doc_id * 60000",
}


def duck(columns: dict[str, str], table: str, where: str = "") -> str:
    """A view's DuckDB SQL."""
    words = DUCK | {"odate": _ODATE["duck"]}
    return "SELECT " + ", ".join(f"{e.format(**words)} AS {n}" for n, e in columns.items()) + f" FROM {table}" + (f" WHERE {where}" if where else "")


def view(spark: SparkSession, sf_dir: str, columns: dict[str, str], table: str, where: str = "") -> DataFrame:
    """The same view in Spark."""
    words = SPARK | {"odate": _ODATE["spark"]}
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return (df.where(where) if where else df).selectExpr(*(f"{e.format(**words)} AS {n}" for n, e in columns.items()))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCANS, "events")


def telemetry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TELEMETRY, "events")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ALERTS, "events", "event_type = 'error'")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RUNS, "orders")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CORPUS, "documents").withColumn("file_size", F.octet_length("content").cast("bigint"))


def file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the corpus."""
    return scan(corpus(spark, sf_dir), RULES)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's rows as a findings table, one host's delivered twice."""
    files = conform(file_findings(spark, sf_dir), FINDINGS)
    return files.withColumn("copy", F.explode(F.expr("sequence(1, CASE WHEN hostname = 'src0' THEN 2 ELSE 1 END)"))).drop("copy")


def folder_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle rows of the corpus scans, two for each."""
    hosts = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.min("doc_id").alias("d"))
    folder = F.concat(F.lit("/data/"), (F.col("d") % 5).cast("string"))
    two = hosts.select(F.concat(F.lit("scan_"), "source").alias("scan_id"), folder.alias("folder"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("i"))
    return two.select("scan_id", F.col("i").cast("bigint").alias("event_timestamp_ms"), F.when(F.col("i") == 2, F.col("folder")).otherwise("/old").alias("scan_folder"))


CATALOG = {
    "custkey": "c_custkey",
    "name": "concat('sigscan_', CASE c_custkey % 3 WHEN 0 THEN 'scans' ELSE 'matches' END, '_v', 2 + c_custkey % 4, CASE WHEN c_custkey % 11 = 0 THEN concat('_scan_', c_custkey) ELSE concat('_', lower({slug}), '_', substr(sha1(c_name), 1, 6), CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('_20', 20 + c_custkey % 7, CASE WHEN c_custkey % 12 < 9 THEN '0' ELSE '' END, 1 + c_custkey % 12) END) END)",
    "rows": "c_custkey % 1000",
    "newest_endpoint_ms": "1700000000000 + c_custkey * 60000",
    "newest_ingest_ms": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1700000000000 + c_custkey * 60000 + (c_custkey % 13) * 60000 - 240000 END",
}


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and statistics of tables, from the customers."""
    words = {"slug": "regexp_replace(c_name, '[^A-Za-z0-9]+', '_')"}
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.selectExpr(*(f"{e.format(**words) if n == 'name' else e} AS {n}" for n, e in CATALOG.items()))


def duck_catalog() -> str:
    words = {"slug": "regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')"}
    return "SELECT " + ", ".join(f"{e.format(**words) if n == 'name' else e} AS {n}" for n, e in CATALOG.items()) + " FROM customer"
