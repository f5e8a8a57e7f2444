"""Rows in order within a key, without a task for the whole key.

A key's rows are numbered in range partitions first and then by the few partitions that the key
spans; with numbers at hand, windows are taken over blocks of rows, and what a block needs of
those before it is carried over as one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import work_path

#: Rows of a key that a task takes together.
BLOCK = 1 << 16
#: What follows the last node of a way.
END = 1 << 62


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared work folder and read back, which cuts its lineage."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def sortable(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Columns that can order rows, to break ties."""
    return [c for c, t in df.dtypes if c not in but and not t.startswith(("map", "variant"))]


def matched(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``few``, joined by ``keys`` of which any may be null."""
    renamed = few.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in few.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(renamed[f"__{k}"])
    return rows.join(renamed, on, how).drop(*(f"__{k}" for k in keys))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's number, from 0, among those of its key in the order of
    ``order`` (nulls first). Of rows that are equal in all of it, any may come first."""
    g, part = free_name(df, "__g"), free_name(df, "__part")
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(g, F.monotonically_increasing_id())
    placed = saved(placed, "ordered").withColumn(part, F.shiftright(g, 33))
    blocks = placed.groupBy(*keys, part).agg(F.min(g).alias("__least"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    shift = blocks.select(*keys, part, (F.coalesce(before, F.lit(0)) - F.col("__least")).alias("__shift"))
    return matched(placed, shift, [*keys, part]).withColumn(name, F.col(g) + F.col("__shift")).drop(g, part, "__shift")


def numbered_by_time(df: DataFrame, keys: list[str], name: str, time: str = "_time") -> DataFrame:
    """:func:`numbered` by ``time``, ties by a hash of the row."""
    tie = free_name(df, "__tie")
    return numbered(df.withColumn(tie, F.xxhash64(*sortable(df))), keys, [time, tie], name).drop(tie)


def trailing(df: DataFrame, keys: list[str], number: str, rows: int, columns, block: int = BLOCK) -> DataFrame:
    """``df`` with ``columns(window)``, over the window of each row and the ``rows`` - 1 before it.

    A block gets the last rows of the one before it, of which it needs no others.
    """
    at, own = free_name(df, "__block"), free_name(df, "__own")
    block = max(block, rows)
    b = F.floor(F.col(number) / block)
    next_ = F.when(F.col(number) % block > block - rows, F.array(b, b + 1)).otherwise(F.array(b))
    spread = df.withColumn(own, b).withColumn(at, F.explode(next_))
    out = spread.withColumns(columns(Window.partitionBy(*keys, at).orderBy(number).rowsBetween(1 - rows, 0)))
    return out.where(F.col(at) == F.col(own)).drop(at, own)


def so_far(df: DataFrame, keys: list[str], number: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with, for each name of ``values``, ``{name}_max``, ``{name}_sum`` and ``{name}_n`` of the
    rows up to each: those of its block and, as one row a block, of all blocks before."""
    at = free_name(df, "__block")
    rows = df.withColumn(at, F.floor(F.col(number) / block))
    totals = rows.groupBy(*keys, at).agg(*(f(v).alias(f"__{n}_{s}") for n, v in values.items() for s, f in (("max", F.max), ("sum", F.sum), ("n", F.count))))
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, at, *((F.max if s == "max" else F.sum)(f"__{n}_{s}").over(earlier).alias(f"__{n}_{s}") for n in values for s in ("max", "sum", "n")))
    here = Window.partitionBy(*keys, at).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    out = matched(rows, carried, [*keys, at])
    made = {}
    for n, v in values.items():
        made[f"{n}_max"] = F.greatest(f"__{n}_max", F.max(v).over(here))
        made[f"{n}_sum"] = F.coalesce(F.col(f"__{n}_sum"), F.lit(0)) + F.coalesce(F.sum(v).over(here), F.lit(0))
        made[f"{n}_n"] = F.coalesce(F.col(f"__{n}_n"), F.lit(0)) + F.count(v).over(here)
    return out.withColumns(made).drop(at, *(f"__{n}_{s}" for n in values for s in ("max", "sum", "n")))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row beyond its block on the way from each row, over blocks in order."""
    for number, follows, end, key in _blocks(batches):
        exits = follows.copy()
        for i in range(len(exits) - 1, -1, -1):
            if exits[i] < end:
                exits[i] = exits[exits[i] - number[0]]
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(exits), pa.string()), pa.array(number), pa.array(exits)], names=["k", "node", "next"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block on the way from where it is entered."""
    for number, follows, end, key, entry in _blocks(batches, True):
        found, at = [], entry
        while at < end and at - number[0] < len(number):
            found.append(at)
            at = int(follows[at - number[0]])
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found, pa.int64())], names=["k", "node"])


def _blocks(batches: Iterator[pa.RecordBatch], entries: bool = False):
    """Whole blocks of rows (k, blk, node, next, end and, with ``entries``, entry) sorted so."""
    now, parts = None, []

    def whole():
        number, follows = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return (number, follows, parts[0][2], now[0], *((parts[0][3],) if entries else ()))

    for b in batches:
        keys, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
        number, follows = (b.column(i).to_numpy() for i in (2, 3))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or (keys[i], blocks[i]) != (keys[begin], blocks[begin]):
                if now is not None and now != (keys[begin], blocks[begin]):
                    yield whole()
                    parts = []
                now = (keys[begin], blocks[begin])
                parts.append((number[begin:i], follows[begin:i], b.column(4)[begin].as_py(), b.column(5)[begin].as_py() if entries else None))
                begin = i
    if parts:
        yield whole()


def chain(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k, node) of the nodes on the way from node 0 of each key.

    ``steps`` (k: text, node, next: long) has every node of a key, numbered from 0; ``next`` is
    larger than ``node``, and ``END`` where the way ends. The way through a block of
    nodes is found in the task that has it; between blocks, of which only the nodes where a
    block may be left to are kept, by joins that double what they have reached.
    """
    blk = F.floor(F.col("node") / block)
    rows = saved(steps.select("k", blk.alias("blk"), "node", "next", ((blk + 1) * block).alias("end")), "steps")
    dealt = rows.repartition("k", "blk").sortWithinPartitions("k", "blk", "node")
    exits = saved(dealt.mapInArrow(_exits, "k string, node long, next long"), "exits")
    # Nodes where a block is entered: 0 and all exits.
    entered = exits.select("k", F.col("next").alias("node")).distinct().unionByName(rows.where("node = 0").select("k", "node"))
    hops = saved(exits.join(entered.distinct(), ["k", "node"]), "hops")
    reached = saved(rows.where("node = 0").select("k", "node"), "reached")
    n = reached.count()
    while True:
        more = saved(reached.unionByName(reached.join(hops, ["k", "node"]).select("k", F.col("next").alias("node"))).distinct(), "reached")
        now = more.count()
        reached = more
        if now == n:
            break
        n = now
        twice = hops.select("k", F.col("node").alias("from"), F.col("next").alias("node")).join(hops, ["k", "node"], "inner")
        hops = saved(twice.select("k", F.col("from").alias("node"), "next"), "hops")
    entry = reached.select("k", blk.alias("blk"), F.col("node").alias("entry"))
    walked = rows.join(entry, ["k", "blk"]).repartition("k", "blk").sortWithinPartitions("k", "blk", "node")
    return walked.mapInArrow(_walked, "k string, node long")
