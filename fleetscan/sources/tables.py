"""Readers and writers of the engine's tables."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import CLEANUP_RUNS, COMPACTION_RUNS, FINDINGS, LIFECYCLE, RULESET, TELEMETRY, conform, schema

MAX_PACK_BYTES = 50 << 20


def read_corpus(spark: SparkSession, roots: list[str], hostname: str = "localhost", max_bytes: int = 0) -> DataFrame:
    """Regular files below several roots: hostname, path, modified, file_size and content.

    The size cap is pushed to the listing, so files over it aren't read. Spark's file source
    lists no empty files, so these have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    if max_bytes:
        files = files.where(F.col("length") <= max_bytes)
    return files.select(F.lit(hostname).alias("hostname"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("file_size"), "content")


def corpus_from_table(df: DataFrame, host: str, path: str, content: str, *keep: str) -> DataFrame:
    """A table of texts or bytes as a corpus; ``keep`` names further columns."""
    body = F.col(content).cast("binary")
    return df.select(F.col(host).alias("hostname"), F.col(path).alias("path"), F.octet_length(body).cast("bigint").alias("file_size"), body.alias("content"), *keep)


def load_ruleset(spark: SparkSession, path: str) -> DataFrame:
    """A declarative pack (JSON lines or Parquet) with a status for each rule.

    A pack is at most 50 MB and holds a rule at least, or this raises. A rule is failed if
    it has no name or condition, a string of an unknown kind or without a pattern, and
    skipped if its name was there before. The first of equal names stands.
    """
    raw = spark.read.schema(schema(RULESET)).parquet(path) if path.endswith(".parquet") else spark.read.schema(schema(RULESET)).json(path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > MAX_PACK_BYTES:
        raise ValueError(f"the rule pack has {size} bytes; {MAX_PACK_BYTES} are allowed")
    rules = ruleset_status(raw)
    if rules.isEmpty():
        raise ValueError("the rule pack holds no rule")
    return rules


def ruleset_status(rules: DataFrame) -> DataFrame:
    kinds = F.array(*map(F.lit, ("literal", "regex", "hex")))
    bad = F.exists(F.coalesce("strings", F.array().cast(rules.schema["strings"].dataType)), lambda s: s["pattern"].isNull() | (s["pattern"] == "") | ~F.array_contains(kinds, F.coalesce(s["kind"], F.lit("literal"))))
    place = F.row_number().over(Window.partitionBy("rule").orderBy(F.monotonically_increasing_id()))
    return rules.withColumn("__n", place).withColumn("status", F.when(F.col("rule").isNull() | F.col("condition").isNull() | bad, "failed").when(F.col("__n") > 1, "skipped").otherwise("valid")).drop("__n")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON, one object a line; broken lines and JSON arrays keep their text in
    ``_corrupt_record``."""
    return spark.read.schema(schema(TELEMETRY + ", _corrupt_record string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_telemetry(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def read_union(dfs: list[DataFrame], text: str = FINDINGS) -> DataFrame:
    """All shards and schema versions; a column that some or all lack is null."""
    return conform(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs), text)


def overwrite_host_findings(df: DataFrame, path: str, hosts: list[str] | None = None) -> None:
    """Replace the rows of the hosts in ``df``; other hosts' partitions stay. ``hosts`` names
    all that were scanned: those of them without rows are clean now, and their former rows
    go. A missing table is made; without rows and hosts nothing changes."""
    spark, rows = df.sparkSession, conform(df, FINDINGS)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hostname").parquet(path)
    if hosts:
        found = {r[0] for r in rows.where(F.col("hostname").isin(hosts)).select("hostname").distinct().collect()}  # some of the named hosts
        clean = [h for h in hosts if h not in found]
        if clean and folders_of(spark, path):
            delete_rows(spark, path, F.col("hostname").cast("string").isin(clean), "hostname")


def append_lifecycle(df: DataFrame, path: str) -> None:
    """Append lifecycle rows, in a partition for each month of the event."""
    rows = conform(df, LIFECYCLE)
    rows.withColumn("month", F.date_format(F.timestamp_millis("event_timestamp_ms"), "yyyyMM")).write.mode("append").partitionBy("month").parquet(path)


def write_alerts(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_compaction_run(spark: SparkSession, path: str, status: str, consolidated: int = 0, failed_ids: list[str] | None = None, reasons: dict | None = None, error: str | None = None, now_ms: int | None = None) -> None:
    """One row of the run log: started, success, partial_failure or crashed."""
    failed = failed_ids or []
    row = (now_ms or int(time.time() * 1000), status, consolidated, len(failed), ",".join(failed), json.dumps(reasons or {}, sort_keys=True), (error or "")[:500])
    spark.createDataFrame([row], schema(COMPACTION_RUNS)).coalesce(1).write.mode("append").parquet(path)


def append_cleanup_run(spark: SparkSession, path: str, status: str, dry_run: bool, months: int | None, quiet_hours: int, deleted: list[str], kept: int, reasons: dict, error: str | None = None, now_ms: int | None = None) -> None:
    """One row of the cleanup log; -1 stands for no window, long lists are cut."""
    row = (now_ms or int(time.time() * 1000), status, dry_run, -1 if months is None else months, quiet_hours, len(deleted), ",".join(deleted)[:4000], kept, json.dumps(reasons, sort_keys=True)[:8000], (error or "")[:500])
    spark.createDataFrame([row], schema(CLEANUP_RUNS)).coalesce(1).write.mode("append").parquet(path)


def delete_rows(spark: SparkSession, path: str, gone: Column | DataFrame, partition: str) -> int:
    """Delete exactly the rows for which ``gone`` is true, or whose values of ``gone``'s columns are a
    row of it, from a table with a partition column; only partitions with such rows are
    rewritten. Returns how many went.

    The partitions' folders are taken from the files, so null and escaped values are folders
    like others. What stays of them is written aside, in full, before the first folder is
    touched; a call that ended in between is finished by the next one. Afterwards no such
    row is left, or this raises. One writer at a time is assumed.
    """
    path = path.rstrip("/")
    _finish_delete(spark, path, partition)
    shape = _shape(spark, path, partition)

    def split(rows: DataFrame, stay: bool) -> DataFrame:
        if isinstance(gone, DataFrame):
            return rows.join(gone, gone.columns, "left_anti" if stay else "left_semi").select(*rows.columns)
        doomed = F.coalesce(gone, F.lit(False))
        return rows.where(~doomed if stay else doomed)

    rows = spark.read.schema(shape).parquet(path)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    counts = {r["__folder"]: r["n"] for r in split(rows.withColumn("__folder", folder), False).groupBy("__folder").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    if not counts:
        return 0
    # Paths of files are URIs; Hadoop gives the folders' own names.
    folders = [_path(spark, spark._jvm.java.net.URI(f)).toString() for f in counts]
    side, touched = f"{path}__rewrite", f"{path}__touched"
    spark.createDataFrame([(f,) for f in folders], "folder string").coalesce(1).write.mode("overwrite").parquet(touched)
    split(spark.read.schema(shape).option("basePath", path).parquet(*folders), True).write.mode("overwrite").partitionBy(partition).parquet(side)
    _finish_delete(spark, path, partition)
    if not split(spark.read.schema(shape).parquet(path), False).isEmpty():
        raise RuntimeError(f"rows of {path} weren't deleted")
    return sum(counts.values())


def _finish_delete(spark: SparkSession, path: str, partition: str) -> None:
    """Put what was written aside in its place, if it was written in full."""
    side, touched = f"{path}__rewrite", f"{path}__touched"
    if _exists(spark, f"{side}/_SUCCESS") and _exists(spark, f"{touched}/_SUCCESS"):
        folders = [r["folder"] for r in spark.read.schema("folder string").parquet(touched).collect()]
        kept = {s.getPath().getName() for s in _fs(spark, side).listStatus(_path(spark, side)) if s.isDirectory()}
        if kept:
            spark.read.schema(_shape(spark, side, partition)).parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        for f in folders:
            if f.rsplit("/", 1)[-1] not in kept:
                remove(spark, f)
    for f in (side, touched):
        if _exists(spark, f):
            remove(spark, f)


def _shape(spark: SparkSession, path: str, partition: str) -> StructType:
    """A table's schema with its partition column as text, as the folders spell it (a host
    007 is no number)."""
    return StructType([StructField(f.name, StringType()) if f.name == partition else f for f in spark.read.parquet(path).schema])


def _path(spark: SparkSession, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def folders_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    return [s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)) if s.isDirectory()] if _exists(spark, path) else []


def written(spark: SparkSession, path: str) -> bool:
    """Whether Spark wrote a table here and committed it."""
    return _exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that may be gone already; anything else that stays raises."""
    if not _fs(spark, path).delete(_path(spark, path), True) and _exists(spark, path):
        raise RuntimeError(f"{path} wasn't removed")


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name, which mustn't be there."""
    if not _fs(spark, path).rename(_path(spark, path), _path(spark, to)):
        raise RuntimeError(f"{path} wasn't renamed to {to}")
