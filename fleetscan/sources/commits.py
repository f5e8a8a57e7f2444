"""A table that many writers change at once.

Rows lie in ``data``, in folders by the commit that wrote them and by the table's partition
column.  A commit writes its rows first, which nobody reads yet, and then its entry in ``log``: the
next number's file, which is made at once and whole, or not at all.  Of two writers one gets
the number; the other looks at what came in between and tries the next.  An entry names the
partitions of earlier commits that it takes away.  Readers take the entries that are there when
they begin, so they see the table as of one commit, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import _exists, _fs, _path, folders_of, remove, written

ENTRY = "version long, commit string, schema string, partitions array<string>, removed array<struct<commit:string,partition:string>>"
#: Tries of a commit before it gives up.
TRIES = 1000


class Conflict(RuntimeError):
    """What a commit would take away was changed meanwhile."""


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text unless it is there; it never has a part of the text.

    Its text is written aside and then given the name: by a link on a local or mounted file
    system, elsewhere by a rename that doesn't replace, as HDFS has. Object stores without one
    need a file system that has.
    """
    fs, target = _fs(spark, path), _path(spark, path)
    aside = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(target) and fs.rename(aside, target)
    finally:
        if fs.exists(aside):
            fs.delete(aside, False)


def _versions(spark: SparkSession, table: str) -> int:
    """The number of the next commit. Entries are numbered without gaps, so the last is found by
    doubling and halving, however many there are."""
    there = lambda n: _exists(spark, f"{table}/log/{n:012d}.json")
    if not there(0):
        return 0
    low, high = 0, 1
    while there(high):
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if there(middle) else (low, middle)
    return high


def log(spark: SparkSession, table: str, below: int | None = None) -> DataFrame:
    """The entries (see ``ENTRY``), those below a version where it is given."""
    if not _exists(spark, f"{table}/log"):
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(ENTRY).json(f"{table}/log/*.json")
    return rows if below is None else rows.where(F.col("version") < below)


def live(spark: SparkSession, table: str, below: int | None = None) -> DataFrame:
    """(commit, partition) of what is in the table: a row for each partition of a commit that
    no later one has taken away. Partitions are spelled as folders spell them, null as null."""
    entries = log(spark, table, below)
    added = entries.select("commit", F.explode("partitions").alias("partition"))
    gone = entries.select(F.explode("removed").alias("r")).select(F.col("r.commit").alias("__c"), F.col("r.partition").alias("__p"))
    return added.join(gone, (F.col("commit") == F.col("__c")) & F.col("partition").eqNullSafe(F.col("__p")), "left_anti")


def _stored(spark: SparkSession, table: str, partition: str, version: int) -> DataFrame:
    """The table's rows as of a version, with their ``commit`` and the folder's spelling of the
    partition. Only commits that count are listed, a path for each; columns that one lacks are
    null."""
    here = live(spark, table, version).withColumnRenamed("partition", "__p").withColumnRenamed("commit", "__c")
    names = [r[0] for r in here.select("__c").distinct().collect()]  # a name for each commit that counts
    if not names:
        shape = StructType.fromJson(json.loads(log(spark, table, version).orderBy(F.desc("version")).first()["schema"])) if version else StructType()
        return spark.createDataFrame([], shape.add("commit", "string").add(f"__{partition}", "string"))
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{table}/data").parquet(*(f"{table}/data/commit={c}" for c in names))
    return rows.join(here, (F.col("commit") == F.col("__c")) & F.col(f"__{partition}").cast("string").eqNullSafe(F.col("__p")), "left_semi")


def read(spark: SparkSession, table: str, partition: str, version: int | None = None) -> DataFrame:
    """The table's rows as of now, or of a ``version`` (the number of commits that count)."""
    now = _versions(spark, table)
    return _stored(spark, table, partition, now if version is None else min(version, now)).drop("commit", f"__{partition}")


def _write(df: DataFrame, table: str, partition: str) -> tuple[str, list]:
    """Write a commit's rows, unread so far; its name and partitions. Rows are in partitions by
    the text of ``partition``, and keep the column itself, with its own type."""
    commit = uuid.uuid4().hex
    path = f"{table}/data/commit={commit}"
    df.withColumn(f"__{partition}", F.col(partition).cast("string")).write.partitionBy(f"__{partition}").parquet(path)
    spark = df.sparkSession
    if not folders_of(spark, path):
        return commit, []
    shape = spark.read.option("basePath", path).parquet(path)
    return commit, [r[0] for r in shape.select(F.col(f"__{partition}").cast("string")).distinct().collect()]  # a name for each partition of this commit


def _enter(spark: SparkSession, table: str, commit: str, shape: StructType, partitions: list, taken, checked: int | None = None) -> int:
    """Enter a commit. ``taken(version)`` gives what it takes away as of a version; where
    ``checked`` is given, the commit was made from that version and what it takes away must be
    there still."""
    _fs(spark, table).mkdirs(_path(spark, f"{table}/log"))
    expected = None if checked is None else {tuple(r) for r in taken(checked)}
    for _ in range(TRIES):
        version = _versions(spark, table)
        removed = taken(version)
        if expected is not None and {tuple(r) for r in removed} != expected:
            raise Conflict(f"{table} was changed since version {checked}")
        entry = {"version": version, "commit": commit, "schema": shape.json(), "partitions": partitions, "removed": [{"commit": c, "partition": p} for c, p in removed]}
        if _create(spark, f"{table}/log/{version:012d}.json", json.dumps(entry)):
            return version
        time.sleep(random.random() * 0.05)
    raise Conflict(f"{table}: no commit in {TRIES} tries")


def append(df: DataFrame, table: str, partition: str) -> int:
    """Add rows; returns the commit's number. Appends never conflict."""
    commit, partitions = _write(df, table, partition)
    return _enter(df.sparkSession, table, commit, df.schema, partitions, lambda version: [])


def replace(df: DataFrame, table: str, partition: str, values: list[str] | None = None) -> int:
    """Put rows in the place of all that there are of their partitions, and of those in ``values``
    (such as hosts that were scanned and are clean now). Whoever comes later counts: what another
    writer enters in between is replaced too."""
    spark = df.sparkSession
    commit, partitions = _write(df, table, partition)
    named = list(dict.fromkeys([*partitions, *(values or [])]))
    wanted = spark.createDataFrame([(v,) for v in named], "__v string")

    def taken(version: int) -> list:
        rows = live(spark, table, version)
        return rows.join(wanted, F.col("partition").eqNullSafe(F.col("__v")), "left_semi").collect()  # folders of the named partitions

    return _enter(spark, table, commit, df.schema, partitions, taken)


def delete(spark: SparkSession, table: str, partition: str, gone: Column, tries: int = 20) -> int:
    """Delete the rows for which ``gone`` is true; returns how many went. Only partitions with such
    rows are written anew. Where another writer takes one of them away meanwhile, this begins
    again."""
    for _ in range(tries):
        version = _versions(spark, table)
        rows = _stored(spark, table, partition, version)
        doomed = F.coalesce(gone, F.lit(False))
        touched = rows.where(doomed).groupBy("commit", F.col(f"__{partition}").cast("string").alias("partition")).agg(F.count("*").alias("n")).collect()  # a row for each folder
        if not touched:
            return 0
        folders = spark.createDataFrame([(r["commit"], r["partition"]) for r in touched], "__c string, __p string")
        stay = rows.join(folders, (F.col("commit") == F.col("__c")) & F.col(f"__{partition}").cast("string").eqNullSafe(F.col("__p")), "left_semi").where(~doomed).drop("commit", f"__{partition}")
        commit, partitions = _write(stay, table, partition)
        taken = {(r["commit"], r["partition"]) for r in touched}

        def still(version: int, taken=taken) -> list:
            return [r for r in live(spark, table, version).collect() if tuple(r) in taken]  # names of folders

        try:
            _enter(spark, table, commit, stay.schema, partitions, still, version)
            return sum(r["n"] for r in touched)
        except Conflict:
            remove(spark, f"{table}/data/commit={commit}")
    raise Conflict(f"{table}: rows to delete were changed {tries} times meanwhile")


def vacuum(spark: SparkSession, table: str, keep: int = 10) -> list[str]:
    """Remove the data of commits none of whose rows count in any of the last ``keep`` versions,
    and return their names. Commits that aren't entered yet stay."""
    now = _versions(spark, table)
    entered = {r[0] for r in log(spark, table).select("commit").collect()}  # names of commits
    used = {r[0] for v in range(max(now - keep + 1, 1), now + 1) for r in live(spark, table, v).select("commit").distinct().collect()}
    gone = sorted(c for c in entered - used if written(spark, f"{table}/data/commit={c}"))
    for c in gone:
        remove(spark, f"{table}/data/commit={c}")
    return gone
