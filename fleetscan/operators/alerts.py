"""Alerts from findings and from resource telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ALERT_LABELS, ALERT_MARK

ALERT_CAP = 500
#: Parts that a scan's alerts are numbered in first.
PARTS = 64
#: Percentages that a resource must exceed.
LIMITS = {"cpu": 90.0, "memory": 85.0, "disk": 95.0}


def alert_label(severity: str):
    labels = F.create_map(*(x for k, v in ALERT_LABELS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(labels, F.lower(F.col(severity))), F.lit("Low"))


def host_ip(ips: str):
    """The first dotted IPv4 address that isn't a loopback, else 127.0.0.1."""
    good = F.filter(F.coalesce(F.col(ips), F.array().cast("array<string>")), lambda x: x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~x.startswith("127."))
    return F.coalesce(F.get(good, F.lit(0)), F.lit("127.0.0.1"))


def build_alerts(findings: DataFrame, path: str = "path", ips: str | None = None) -> DataFrame:
    """One alert for each (scan, host, rule, file)."""
    name = F.element_at(F.split(F.translate(F.col(path), "\\", "/"), "/"), -1)
    title = F.concat(F.lit(f"{ALERT_MARK}: "), F.col("rule"), F.lit(" | "), name, F.lit(" (#"), F.substring(F.sha1(F.col(path).cast("binary")), 1, 8), F.lit(") | Host: "), F.col("hostname"))
    rows = findings.dropDuplicates(["scan_id", "hostname", "rule", path])
    return rows.select("scan_id", "hostname", "rule", F.col(path).alias("path"), F.col("match_count"), title.alias("alert_name"), alert_label("severity").alias("severity"), (host_ip(ips) if ips else F.lit("127.0.0.1")).alias("ip"), F.to_json(F.struct("rule", F.col(path).alias("file"), "match_count")).alias("alert_description"))


def cap_alerts(alerts: DataFrame, cap: int = ALERT_CAP, order: tuple[str, ...] | None = None) -> DataFrame:
    """The alerts with suppressed: true beyond the first ``cap`` of a scan, in the order of
    their time (``_time`` or ``event_timestamp_ms``, where there is one), path, rule and host.

    A scan's alerts are numbered in parts first; what is behind ``cap`` in its part is so in
    the scan, and only the others, at most ``cap`` a part, are numbered as a whole.
    """
    stamps = [c for c in ("_time", "event_timestamp_ms") if c in alerts.columns][:1]
    ends = tuple(c for c in ("path", "rule", "hostname") if c in alerts.columns)
    by = order or (*stamps, *ends)
    parted = alerts.withColumn("__part", F.pmod(F.xxhash64(*ends), F.lit(PARTS)))
    near = parted.withColumn("__near", F.row_number().over(Window.partitionBy("scan_id", "__part").orderBy(*by)) <= cap)
    whole = Window.partitionBy("scan_id", F.when(F.col("__near"), F.lit(-1)).otherwise(F.col("__part"))).orderBy(*by)
    return near.withColumn("suppressed", ~F.col("__near") | (F.row_number().over(whole) > cap)).drop("__part", "__near")


def rollup_alerts(capped: DataFrame) -> DataFrame:
    """One alert for each rule over what was suppressed, most first."""
    return capped.where("suppressed").groupBy("scan_id", "hostname", "rule").agg(F.count("*").alias("suppressed_files"), F.sum("match_count").alias("suppressed_hits")).orderBy(F.desc("suppressed_files"), "scan_id", "hostname", "rule")


def file_alert_events(findings: DataFrame, path: str = "path") -> DataFrame:
    """One event for each matched file."""
    one = F.struct("rule", "match_count", "severity")
    return findings.groupBy("scan_id", "hostname", F.col(path).alias("path")).agg(F.sort_array(F.collect_list("rule")).alias("rules"), F.sum("match_count").alias("hits"), F.sort_array(F.collect_list(one)).alias("detections"))


def resource_alerts(snapshots: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """A row for each resource of a snapshot (hostname, _time, sys_*_percent) over its limit.
    Works on streams: it is a projection and a filter."""
    of = {"cpu": "sys_cpu_percent", "memory": "sys_memory_used_percent", "disk": "sys_disk_used_percent"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("resource"), F.col(of[k]).try_cast("double").alias("value"), F.lit(v).alias("limit")) for k, v in limits.items())))
    return snapshots.select("hostname", "_time", each.alias("r")).select("hostname", "_time", "r.resource", "r.value", "r.limit").where("value > limit")


def alert_count_last_hour(alerts: DataFrame) -> DataFrame:
    """alerts_last_hour: this host's alerts in the hour up to each.

    A host's alerts are counted clock hour by clock hour, each with those of the hour before
    beside its own, so that one host never fills a task.
    """
    hour = F.floor(F.col("_time").cast("double") / 3600)
    rows = alerts.withColumn("__own", hour).withColumn("__hour", F.explode(F.when(hour.isNull(), F.array(hour)).otherwise(F.array(hour, hour + 1))))
    span = Window.partitionBy("hostname", "__hour").orderBy(F.col("_time").cast("double")).rangeBetween(-3600, 0)
    counted = rows.withColumn("alerts_last_hour", F.count("*").over(span))
    return counted.where(F.col("__hour").eqNullSafe(F.col("__own"))).drop("__own", "__hour")
