"""A prefix trie of conversations, built as burst tries (operator 11).

A turn is known by the hash of its role and text.  Conversations are cut into segments of at
most ``SEGMENT`` turns; the turns before a segment are its trie head, and the segments below
one head are suffixes in one container.  Containers with more than ``BURST`` turns are burst:
their suffixes go to a container for each next turn id, and what was their head becomes a
head node.  Equal suffixes are one row with a count, so every container can be burst until it is
small.  The containers left are dealt to shards, sorted, and swept into nodes; head nodes are
sums over the suffixes below them.

A subtree's sums need no walk over the tree.  A conversation owns a node if it is the smallest
that passes through it, which holds from some depth of it on; ``s`` is the number of its turns
before that, and ``a`` their code points.  What a subtree at depth d saves is the sum, over the
conversations through its top with s >= d, of ``a`` less the code points before the top; its
leaves are the owners of leaves among them.  A first sweep finds the owners, a second the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

#: Turns of a segment, suffix turns from which on a container is burst, ids hashed as one block.
SEGMENT, BURST, BLOCK = 256, 1 << 16, 1 << 16

EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = (("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()))


def short_hash(value: Column) -> Column:
    """16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(value.cast("binary"), 256), 1, 32))


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def rebuilt(conversations: DataFrame, base: Column, keep: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, tid, chars) of the turns, ``at`` from 1, and (conv_id, turns) of all
    conversations, those left without turns included.

    A conversation (over the column conv_id) gets the first ``keep`` turns of conversation
    ``base`` (itself: it stays as it is; absent: none) and its own after its first ``keep``. Turns
    are ordered by ``turn``, nulls first, then by the hash of role and text, where null is empty;
    repeated rows are turns of their own. Rows without a conversation are left out.

    Rows are numbered in range partitions first and then by the few partitions that a
    conversation spans, so that one conversation never fills a task.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    tid = short_hash(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), tid.alias("tid"), F.length(t).cast("long").alias("chars"))
    order = ("conv_id", "turn", "tid")
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "tid", "chars", F.monotonically_increasing_id().alias("g")), "turns")
    part = F.shiftright("g", 33).alias("part")
    blocks = materialize(placed.groupBy("conv_id", part).agg(F.min("g").alias("least"), F.count("*").alias("n")), "turn-blocks")
    counts = blocks.groupBy("conv_id").agg(F.sum("n").alias("own"))
    who = counts.withColumns({"base": base, "keep": keep}).withColumn("keep", F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.col("keep")).cast("long"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs"))
    who = who.join(bases, "base", "left").withColumn("given", F.least("keep", F.coalesce("theirs", F.lit(0)))).select("conv_id", "base", "keep", "given", (F.greatest(F.col("own") - F.col("keep"), F.lit(0)) + F.col("given")).alias("turns"))
    who = materialize(who, "conversations")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = blocks.select("conv_id", "part", (before + 1 - F.col("least")).alias("shift"))
    numbered = placed.withColumn("part", part).join(places, ["conv_id", "part"]).select("conv_id", (F.col("g") + F.col("shift")).alias("at"), "tid", "chars")
    moved = numbered.join(who.select("conv_id", "keep", "given"), "conv_id").where("at > keep").select("conv_id", (F.col("at") - F.col("keep") + F.col("given")).alias("at"), "tid", "chars")
    forks = who.where("given > 0").select("conv_id", "base", "given")
    most = forks.agg(F.max("given")).first()[0] or 0
    heads = numbered.where(F.col("at") <= most).withColumnRenamed("conv_id", "base")
    lent = heads.join(forks, "base").where("at <= given").select("conv_id", "at", "tid", "chars")
    return moved.unionByName(lent), who.select("conv_id", "turns")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The heads of a conversation's segments: each the hash of the one before and its segment."""
    fields = (("conv_id", pa.int64()), ("k", pa.int64()), ("head", pa.binary()), ("cb", pa.int64()))
    for b in batches:
        out = []
        for conv, segments in zip(*(c.to_pylist() for c in b.columns), strict=True):
            head, chars = b"", 0
            for s in segments:
                out.append((conv, s["k"], head, chars))
                head, chars = hashlib.sha256(head + s["seg"]).digest()[:16], chars + s["chars"]
        yield _batch(out, fields)


def segments(turns: DataFrame, who: DataFrame, size: int) -> DataFrame:
    """(conv_id, b, cb, head, seg, tids, chars, nxt) of each segment: turns and code points
    before it, head, own hash, its turns, and the first turn id of the one behind it."""
    k = F.floor((F.col("at") - 1) / size)
    rows = turns.withColumn("k", k)
    ahead = rows.where((F.col("at") % size == (1 % size)) & (F.col("at") > 1)).withColumn("k", F.col("k") - 1)
    each = rows.unionByName(ahead).groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("at", "tid", "chars"))).alias("t"))  # at most size + 1 turns
    none = who.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("k"), F.array().cast(each.schema["t"].dataType).alias("t"))
    own = F.slice("t", 1, size)
    cut = each.unionByName(none).select("conv_id", "k", F.transform(own, lambda x: x["tid"]).alias("tids"), F.transform(own, lambda x: x["chars"]).alias("chars"), F.get("t", F.lit(size))["tid"].alias("nxt"))
    cut = materialize(cut.withColumn("seg", short_hash(F.array_join(F.transform("tids", F.hex), ""))), "segments")
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    long = cut.where("k > 0").select("conv_id").distinct()
    lists = cut.join(long, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "seg", total.alias("chars")))).alias("s"))  # 32 bytes a segment
    heads = lists.mapInArrow(_chained, "conv_id long, k long, head binary, cb long")
    placed = cut.join(heads, ["conv_id", "k"], "left")
    return placed.select("conv_id", (F.col("k") * size).alias("b"), F.coalesce("cb", F.lit(0)).alias("cb"), F.coalesce("head", F.lit(b"")).alias("head"), "seg", "tids", "chars", "nxt")


def ends(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(head, seg, ends): SHA-256 of the ids of the conversations that end with a segment.

    Ids are joined in blocks of ``block`` consecutive numbers; a group's blocks are hashed one
    after another as they stream by, so a group of any size takes the memory of one.
    """
    last = members.where("nxt IS NULL").select("head", "seg", "conv_id", F.floor(F.col("conv_id") / block).alias("blk"))
    blocks = last.groupBy("head", "seg", "blk").agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = (("head", pa.binary()), ("seg", pa.binary()), ("ends", pa.string()))
        now, sha = None, None
        for b in batches:
            out = []
            for head, seg, ids in zip(*(b.column(c).to_pylist() for c in ("head", "seg", "ids")), strict=True):
                if (head, seg) == now:
                    sha.update(b"," + ids.encode())
                else:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (head, seg), hashlib.sha256(ids.encode())
            yield _batch(out, fields)
        if sha:
            yield _batch([(*now, sha.hexdigest())], fields)

    return blocks.repartition("head", "seg").sortWithinPartitions("head", "seg", "blk").mapInArrow(run, "head binary, seg binary, ends string")


def burst(suffixes: DataFrame, limit: int) -> DataFrame:
    """``suffixes`` with ``keys`` (their head nodes, from the top), ``key`` (their container, null
    for a suffix that is a head node's whole path) and ``j`` (turns from the head to it).

    Each round reads only the suffixes of containers that are still too large; as these differ,
    there are no more rounds than turns in a segment.
    """
    rows = suffixes.select("*", F.array().cast("array<binary>").alias("keys"), F.col("head").alias("key"), F.lit(0).alias("j"))
    done, j = None, 0
    while True:
        weights = rows.where("key IS NOT NULL").groupBy("key").agg(F.sum(F.size("tids") - j + 1).alias("w"), F.count("*").alias("n"))
        large = materialize(weights.where((F.col("w") > limit) & (F.col("n") > 1)).select("key", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            return materialize(rows if done is None else done.unionByName(rows), "containers")
        split = rows.join(large, "key", "left")
        small = split.where("large IS NULL").drop("large")
        done = small if done is None else done.unionByName(small)
        child = F.when(F.size("tids") > j, short_hash(F.concat("key", F.get("tids", F.lit(j)))))
        rows = materialize(split.where("large").drop("large").withColumns({"keys": F.concat("keys", F.array("key")), "key": child, "j": F.lit(j + 1)}), "burst")
        j += 1


class Container:
    """The nodes of one container's suffixes, which come sorted."""

    def __init__(self, rows: list[dict]):
        self.rows, self.j, self.b = rows, rows[0]["j"], rows[0]["b"]
        self.depth, self.parent, self.ends_at, self.before = [self.j], [-1], [], [0]
        self.paths: list[list[int]] = []
        path, prev = [0], []
        cb = rows[0]["cb"]
        if self.j:
            self.before[0] = cb + sum(rows[0]["chars"][: self.j - 1])
        for r in rows:
            tids, chars = r["tids"], r["chars"]
            common = self.j
            while common < min(len(prev), len(tids)) and prev[common] == tids[common]:
                common += 1
            path = path[: common - self.j + 1]
            before = cb + sum(chars[:common])
            for d in range(common + 1, len(tids) + 1):
                self.depth.append(d)
                self.parent.append(path[-1])
                self.before.append(before)
                before += chars[d - 1]
                path.append(len(self.depth) - 1)
            self.paths.append(path)
            prev = tids
        self.least = [1 << 63] * len(self.depth)
        for r, p in zip(rows, self.paths, strict=True):
            for x in p:
                self.least[x] = min(self.least[x], r["m"])
        if not self.j and self.b:
            self.least[0] = rows[0]["boundary"]

    def owners(self) -> Iterator[tuple]:
        """(conv_id, s, a, leaf) for each suffix's smallest conversation."""
        inner = set(self.parent)
        for r, p in zip(self.rows, self.paths, strict=True):
            s = a = None
            for x in p:
                if self.depth[x] and self.least[x] == r["m"]:
                    s, a = self.b + self.depth[x] - 1, self.before[x]
                    break
            yield r["m"], s, a, p[-1] not in inner and not r["n_next"]

    def nodes(self) -> Iterator[tuple]:
        size = len(self.depth)
        n, children, leaves, owed, times, ends = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size, [EMPTY] * size
        for x in self.parent[1:]:
            children[x] += 1
        for r, p in zip(self.rows, self.paths, strict=True):
            for x in p:
                n[x] += r["n"]
                leaves[x] += r["leaves"]
                owed[x] += r["others_a"]
                times[x] += r["n"] - 1
                if r["s0"] >= self.b + self.depth[x]:
                    owed[x] += r["a0"]
                    times[x] += 1
            children[p[-1]] += r["n_next"]
            ends[p[-1]] = r["ends"] or EMPTY
        for x in range(size):
            if x or self.j or not self.b:
                above = self.rows[0]["above"] if not x else self.least[self.parent[x]]
                yield self.least[x], self.b + self.depth[x], above, n[x], children[x], leaves[x], owed[x] - times[x] * self.before[x], ends[x]


def _swept(containers: DataFrame, take, fields: tuple, schema: str) -> DataFrame:
    """What ``take`` yields of each container, in shards of containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now and now[0]["key"] != r["key"]:
                    out += take(Container(now))
                    now = []
                now.append(r)
            yield _batch(out, fields)
        if now:
            yield _batch(list(take(Container(now))), fields)

    return containers.where("key IS NOT NULL").repartition("key").sortWithinPartitions("key", "tids").mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, who: DataFrame, segment: int = SEGMENT, limit: int = BURST, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of conversations (see ``NODE``).

    ``turns`` has conv_id, at (from 1, without gaps), tid and chars; ``who`` has every
    conv_id once, with the number of its turns. The root (depth 0) has every conversation;
    without conversations there are no rows. Of long conversations a segment is a row, and one of
    n turns is listed as n / ``segment`` hashes in one row.
    """
    ship(turns.sparkSession)
    members = materialize(segments(turns, who, segment), "members")
    by_next = members.groupBy("head", "seg", "nxt").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.first("b").alias("b"), F.first("cb").alias("cb"), F.first("tids").alias("tids"), F.first("chars").alias("chars"))
    suffixes = by_next.groupBy("head", "seg").agg(F.sum("n").alias("n"), F.min("m").alias("m"), F.count("nxt").alias("n_next"), F.first("b").alias("b"), F.first("cb").alias("cb"), F.first("tids").alias("tids"), F.first("chars").alias("chars"))
    suffixes = materialize(suffixes.join(ends(members, block), ["head", "seg"], "left"), "suffixes")
    # The smallest conversation through the node above a segment may end there.
    above = suffixes.where("n_next > 0").select(short_hash(F.concat("head", "seg")).alias("head"), F.col("m").alias("boundary"))
    first = suffixes.where("b = 0").withColumn("boundary", F.lit(None).cast("long"))
    rows = burst(materialize(first.unionByName(suffixes.where("b > 0").join(above, "head")), "placed"), limit)

    # Owners: in containers by a sweep, of head nodes by their smallest conversation.
    path = rows.where(F.size("keys") > 0).select("*", F.posexplode("keys").alias("d", "top"))
    path = path.withColumns({
        "above": F.get("keys", F.col("d") - 1),
        "before": F.col("cb") + F.aggregate(F.slice("chars", 1, F.greatest(F.col("d") - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x),
    })
    tops = materialize(path.groupBy("top", "above", "d", "b", "before").agg(F.coalesce(F.when(F.col("d") == 0, F.first("boundary")), F.min("m")).alias("m")), "heads")
    swept = _swept(rows, Container.owners, (("conv_id", pa.int64()), ("s", pa.int64()), ("a", pa.int64()), ("leaf", pa.bool_())), "conv_id long, s long, a long, leaf boolean")
    owners = swept.unionByName(tops.where("d > 0").select(F.col("m").alias("conv_id"), (F.col("b") + F.col("d") - 1).alias("s"), F.col("before").alias("a"), F.lit(False).alias("leaf")))
    owners = owners.groupBy("conv_id").agg(F.min("s").alias("s"), F.min("a").alias("a"), F.bool_or("leaf").alias("leaf"))
    length = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = members.where("nxt IS NULL").select("conv_id", (F.col("b") + F.size("tids")).alias("turns"), (F.col("cb") + length).alias("total"))
    shares = whole.join(owners, "conv_id", "left").select("conv_id", F.coalesce("s", "turns").alias("s"), F.coalesce("a", "total").alias("a"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    sums = members.select("head", "seg", "conv_id").join(materialize(shares, "owners"), "conv_id").groupBy("head", "seg").agg(
        F.min_by("s", "conv_id").alias("s0"), F.min_by("a", "conv_id").alias("a0"), F.sum("a").alias("sum_a"), F.count_if("leaf").alias("leaves")
    )
    rows = materialize(rows.join(sums.withColumn("others_a", F.col("sum_a") - F.col("a0")).drop("sum_a"), ["head", "seg"]), "summed")

    # Head nodes, first by their next turn, so that a head of very many is summed where they are.
    path = rows.where(F.size("keys") > 0).select("*", F.posexplode("keys").alias("d", "top"))
    path = path.join(tops.select("top", "before", F.col("m").alias("least")), "top")
    saved = F.col("others_a") - (F.col("n") - 1) * F.col("before") + F.when(F.col("s0") >= F.col("b") + F.col("d"), F.col("a0") - F.col("before")).otherwise(0)
    here = F.size("tids") == F.col("d")
    by_turn = path.groupBy("top", "b", "d", "least", F.get("tids", F.col("d")).alias("t")).agg(F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum(saved).alias("saved"), F.max(F.when(here, F.col("ends"))).alias("ends"), F.max(F.when(here, F.col("n_next"))).alias("n_next"))
    heads = by_turn.groupBy("top", "b", "d", "least").agg(F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), (F.count("t") + F.coalesce(F.max("n_next"), F.lit(0))).alias("children"))
    above = tops.select("top", F.col("above").alias("up")).join(tops.select(F.col("top").alias("up"), F.col("m").alias("parent")), "up").select("top", "parent")
    heads = heads.where("d > 0 OR b = 0").join(above, "top", "left")
    head_nodes = heads.select(F.col("least").alias("conv_id"), (F.col("b") + F.col("d")).alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))

    below = tops.select(F.col("top").alias("up"), F.col("m").alias("above"))
    placed = rows.withColumn("up", F.try_element_at("keys", F.lit(-1))).join(below, "up", "left").select("key", "j", "b", "cb", "tids", "chars", "n", "m", "n_next", "ends", "s0", "a0", "others_a", "leaves", "above", "boundary")
    return head_nodes.unionByName(_swept(placed, Container.nodes, _NODE, NODE))
