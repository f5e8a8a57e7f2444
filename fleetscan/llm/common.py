"""Shared helpers of the training-data operators: the shared work folder, written
intermediate tables, shipping of this package to executors, and row hygiene."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..work import shared_dir, work_path


__all__ = ["fresh", "hash_fraction", "in_fold", "join_classes", "materialize", "open_fs", "read_table", "shared_dir", "ship", "spread", "work_path"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor never makes earlier stages run again, and
    the table is evaluated once however many consumers it has.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, size: str, target: int, *order: str) -> DataFrame:
    """``df``, a small table of places in files, over so many range partitions (in the order
    of the columns ``order``) that each stands for about ``target`` of the sum of ``size``.

    Adaptive execution judges a partition by the table's own bytes, not by those that its
    rows point to, but leaves an explicit count as it is. At least the session's default
    parallelism is used.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(size)).first()[0] or 0
    parts = max(-(-int(total) // target), spark.sparkContext.defaultParallelism)
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


#: Rows of a key from which on a join gets it by broadcast.
HOT_ROWS = 200_000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``classes``, which has each ``key`` once and in ``n`` how many of
    ``rows`` have it; both are written tables, and no key is null.

    Keys of over ``hot`` rows are joined where their rows are, so that one key never fills a
    task: there is at most one such key for ``hot`` rows, which bounds the broadcast. Other
    keys are joined as Spark sees fit.
    """
    few = classes.where(F.col(n) > hot)
    if few.isEmpty():
        return rows.join(classes, key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(classes.where(F.col(n) <= hot), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and inner path of a shared-folder URI (file, hdfs, s3, gs)."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_fraction(cols: list, fraction: float, salt: str) -> Column:
    """True for a deterministic pseudo-random ``fraction`` of the keys."""
    limit = int(min(1.0, max(0.0, fraction)) * (1 << 62))
    return F.xxhash64(F.lit(salt), *cols).bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(limit)


def in_fold(col: str, modulus: int, remainder: int) -> Column:
    """Whether ``crc32(col as text) mod modulus`` is ``remainder``; false for null."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
