"""Telemetry: nested JSON to columns, and resource metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..schemas import ESTIMATES, MATCH, PERFORMANCE, PROGRESS, SNAPSHOT, STATISTICS, SUMMARY
from .ordered import BLOCK, END, chain, free_name, matched, numbered, numbered_by_time, saved, so_far, sortable, trailing

#: The columns of each kind of row and their places in its JSON, in order.
BLOCKS: dict[str, dict[str, str]] = {
    "match": {"file_name": "filename", "offset": "offset", "rule_id": "rule", "string": "string", "match_scope": "match_scope", "match_count": "match_count", "offsets": "offsets", "strings": "strings", "match_ids": "match_ids", "truncated": "truncated"},
    "performance": {"worker_id": "worker_id", "files_processed": "files_processed", "avg_processing_time_ms": "avg_processing_time_ms", "error_rate_percent": "error_rate_percent"},
    "progress": {
        "files_scanned": "files_scanned",
        "files_skipped": "files_skipped",
        "total_detections": "total_detections",
        "queue_size": "queue_size",
        "scan_rate_files_per_sec": "scan_rate_files_per_sec",
        **{c: f"metrics.{c}" for c in ("cpu_percent", "memory_mb", "disk_io_mb", "network_mb", "active_workers", "elapsed_seconds", "eta_seconds", "junction_skips", "unique_real_paths")},
    },
    "estimates": {c: c for c in ("eta_seconds", "estimated_completion", "current_rate_files_per_sec", "files_remaining")},
    "summary": {
        "phase": "phase",
        **{c: f"system_info.{c}" for c in ("hostname", "ip_addresses", "platform", "python_version", "yara_version", "rule_source")},
        "scan_targets": "system_info.scan_targets[0]",
        **{c: f"system_info.{c}" for c in ("max_workers", "max_file_mb", "upload_enabled", "webhook_key_source", "webhook_endpoint_source", "api_endpoint", "logging_format")},
        **{c: f"compilation_results.{c}" for c in ("valid_rules_compiled", "failed_rules_skipped", "compilation_success_rate")},
    },
    "snapshot": {
        **{f"proc_{c}": f"process.{c}" for c in ("cpu_percent", "memory_mb", "memory_percent", "io_read_mb", "io_write_mb", "thread_count", "file_descriptors")},
        **{f"sys_{c}": f"system.{c}" for c in ("cpu_percent", "memory_total_mb", "memory_available_mb", "memory_used_percent", "disk_total_gb", "disk_free_gb", "disk_used_percent", "load_avg_1m", "load_avg_5m", "load_avg_15m")},
        **{f"net_{c}": f"network.{c}" for c in ("sent_mb", "recv_mb", "total_mb")},
        **{f"eff_{c}": f"efficiency.{c}" for c in ("memory_efficiency", "cpu_efficiency", "io_intensity", "network_intensity")},
        **{f"trend_{c}": f"trends.{c}" for c in ("cpu_trend", "memory_trend", "cpu_avg_10min", "memory_avg_10min", "data_points")},
        "alert_count_last_hour": "alert_count_last_hour",
        "monitoring_duration_minutes": "monitoring_duration_minutes",
    },
}


def _tree() -> str:
    """One schema for all blocks: every leaf is text, whatever its JSON type."""
    leaves: dict[str, set[str]] = {"": set()}
    for block in BLOCKS.values():
        for path in block.values():
            head, _, leaf = path.rpartition(".")
            leaves.setdefault(head, set()).add(leaf)
    nested = [f"`{h}`: struct<{', '.join(f'`{x.split("[")[0]}`: ' + ('array<string>' if '[' in x else 'string') for x in sorted(names))}>" for h, names in sorted(leaves.items()) if h]
    flat = [f"`{x}`: string" for x in sorted(leaves[""])]
    return f"struct<{', '.join(flat + nested)}>"


#: Which rows are of a kind, in SQL.
IS_BLOCK = {
    "match": f"type = '{MATCH}'",
    "performance": f"type = '{PERFORMANCE}'",
    "progress": f"type = '{STATISTICS}' AND contains(message, '{PROGRESS}')",
    "estimates": f"type = '{STATISTICS}' AND contains(message, '{ESTIMATES}')",
    "summary": f"type = '{SUMMARY}'",
    "snapshot": f"type = '{SNAPSHOT}'",
}


def _leaf(path: str) -> str:
    """A path into the parsed JSON; ``x[0]`` is null for a short array."""
    head, bracket, at = path.partition("[")
    return f"get(__j.{head}, {at[:-1]})" if bracket else f"__j.{path}"


def parse_telemetry(raw: DataFrame) -> DataFrame:
    """The rows with the columns of their kind, all as text; rows of no kind stay as they are.

    The JSON is parsed once, and a row's kind is found once. Where two kinds share a column,
    each row has its own kind's. Summary rows take their hostname from the data, null if it
    isn't there. Broken JSON gives nulls. Works on streams.
    """
    kind = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in IS_BLOCK.items()) + " END"
    parsed = raw.selectExpr("*", f"from_json(data, '{_tree()}') AS __j", f"{kind} AS __k")
    places: dict[str, list[tuple[str, str]]] = {}
    for block, columns in BLOCKS.items():
        for name, path in columns.items():
            places.setdefault(name, []).append((block, path))
    out = {n: "CASE __k " + " ".join(f"WHEN '{b}' THEN {_leaf(p)}" for b, p in at) + (" ELSE hostname" if n == "hostname" else "") + " END" for n, at in places.items()}
    return parsed.selectExpr(*(f"`{c}`" for c in raw.columns if c not in out), *(f"{e} AS `{n}`" for n, e in out.items()))


def efficiency_metrics(snapshots: DataFrame) -> DataFrame:
    """Free shares of memory and CPU, and I/O and network in relation to memory (1 at least)."""
    num = lambda c: F.col(c).try_cast("double")
    per = F.greatest(num("proc_memory_mb"), F.lit(1.0))
    return snapshots.withColumns({
        "memory_efficiency": 100 - num("sys_memory_used_percent"),
        "cpu_efficiency": 100 - num("sys_cpu_percent"),
        "io_intensity": F.round((num("proc_io_read_mb") + num("proc_io_write_mb")) / per, 6),
        "network_intensity": F.round(num("net_total_mb") / per, 6),
    })


def resource_trends(snapshots: DataFrame, kept: int = 360, block: int = BLOCK) -> DataFrame:
    """Trend, mean and data points of CPU and memory over the last ``kept`` snapshots of a
    host; no trend with under 2, stable with under 5. Snapshots of one time are in the order of
    a hash of the row. A host's snapshots are taken in blocks of ``block``."""

    def columns(recent: WindowSpec) -> dict[str, Column]:
        n = F.count("*").over(recent)

        def trend(col: str, limit: float) -> Column:
            v = F.col(col).try_cast("double")
            slope = F.when(n >= 5, (v - F.first(v).over(recent)) / n).otherwise(F.lit(0.0))
            return F.when(n < 2, F.lit(None)).when(slope > limit, "increasing").when(slope < -limit, "decreasing").otherwise("stable")

        mean = lambda c: F.when(n >= 2, F.round(F.avg(F.col(c).try_cast("double")).over(recent), 6))
        return {"cpu_trend": trend("sys_cpu_percent", 2.0), "memory_trend": trend("sys_memory_used_percent", 5.0), "cpu_avg": mean("sys_cpu_percent"), "memory_avg": mean("sys_memory_used_percent"), "data_points": F.when(n >= 2, n).otherwise(F.lit(0))}

    at = free_name(snapshots, "__at")
    rows = numbered_by_time(snapshots, ["hostname"], at)
    return trailing(rows, ["hostname"], at, kept, columns, block).drop(at)


def resource_summary(snapshots: DataFrame, keys: tuple[str, ...] = ("scan_id", "hostname")) -> DataFrame:
    """Least, most, mean and current values of a scan's resources."""
    out = []
    for name, col in (("cpu", "proc_cpu_percent"), ("memory_mb", "proc_memory_mb"), ("sys_cpu", "sys_cpu_percent"), ("sys_memory", "sys_memory_used_percent")):
        v = F.col(col).try_cast("double")
        out += [F.min(v).alias(f"min_{name}"), F.max(v).alias(f"max_{name}"), F.round(F.avg(v), 6).alias(f"avg_{name}"), F.max_by(v, "_time").alias(f"current_{name}")]
    return snapshots.groupBy(*keys).agg(F.count("*").alias("snapshots"), *out)


def performance_metrics(snapshots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Peak and mean CPU and memory of the scanner process so far, snapshots of one time in the
    order of a hash of the row. A host's snapshots are taken in blocks of ``block``."""
    at = free_name(snapshots, "__at")
    of = {"cpu": F.col("proc_cpu_percent").try_cast("double"), "memory_mb": F.col("proc_memory_mb").try_cast("double")}
    out = so_far(numbered_by_time(snapshots, ["hostname"], at), ["hostname"], at, {f"__{n}": v for n, v in of.items()}, block)
    made = {}
    for n in of:
        made |= {f"peak_{n}": F.col(f"__{n}_max"), f"avg_{n}": F.round(F.try_divide(f"__{n}_sum", f"__{n}_n"), 6)}
    return out.withColumns(made).drop(at, *(f"__{n}_{s}" for n in of for s in ("max", "sum", "n")))


def throttle_reports(reports: DataFrame, interval_secs: float = 30, hot: int = BLOCK) -> DataFrame:
    """A worker's first report, and each that comes ``interval_secs`` or more after the last
    one kept (0: all); rows without a time are left out. Of reports of one time, the one with the
    least hash of the row counts.

    Which reports are kept depends on those kept before. The reports of a worker with at most
    ``hot`` of them are passed through in order of time. Those of others are numbered, each is
    given the first that may follow it, and the way from the first is taken by blocks (see
    :func:`~.ordered.chain`), so that no worker fills a task.
    """
    rows = reports.where(F.col("_time").isNotNull())
    if not interval_secs:
        return rows
    keys, least = ["hostname", "worker_id"], int(interval_secs * 1_000_000)
    many = saved(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot), "hot-workers")
    if many.isEmpty():
        return _in_order(rows, keys, least)
    few = rows.join(many.select(*(F.col(k).alias(f"__{k}") for k in keys)), F.col("hostname").eqNullSafe(F.col("__hostname")) & F.col("worker_id").eqNullSafe(F.col("__worker_id")), "left_anti")
    return _in_order(few, keys, least).unionByName(_by_blocks(matched(rows, many, keys).drop("__n"), keys, least, hot))


def _in_order(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    micros, tie = free_name(rows, "__us"), free_name(rows, "__tie")
    ordered = rows.withColumns({micros: F.unix_micros("_time"), tie: F.xxhash64(*sortable(rows))}).repartition(*keys).sortWithinPartitions(*keys, micros, tie).drop(tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last = None, 0
        for b in batches:
            names = [b.schema.get_field_index(k) for k in (*keys, micros)]
            keep = []
            for i, (host, worker, us) in enumerate(zip(*(b.column(n).to_pylist() for n in names), strict=True)):
                if (host, worker) != who or us - last >= least:
                    who, last = (host, worker), us
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).drop_columns([micros])

    return ordered.mapInArrow(run, rows.schema)


def _by_blocks(rows: DataFrame, keys: list[str], least: int, block: int) -> DataFrame:
    at, k = free_name(rows, "__at"), free_name(rows, "__k")
    all_ = saved(numbered_by_time(rows, keys, at).withColumn(k, F.to_json(F.struct(*keys))), "reports")
    times = all_.select(F.col(k).alias("k"), F.unix_micros("_time").alias("t"), F.lit(1).alias("kind"), F.col(at).alias("node"))
    # Where a time that is late enough stands among the reports: as many of both are before it as
    # there are such times (of the reports before) and reports (before the one that follows).
    wanted = times.select("k", (F.col("t") + least).alias("t"), F.lit(0).alias("kind"), "node")
    last = times.groupBy("k").agg(F.max("node").alias("last"))
    ranked = numbered(times.unionByName(wanted), ["k"], ["t", "kind", "node"], "at").where("kind = 0").join(last, "k")
    steps = ranked.select("k", "node", F.when(F.col("at") - F.col("node") > F.col("last"), F.lit(END)).otherwise(F.col("at") - F.col("node")).alias("next"))
    kept = chain(steps, block)
    return all_.join(kept.select(F.col("k").alias(k), F.col("node").alias(at)), [k, at]).select(*rows.columns)
