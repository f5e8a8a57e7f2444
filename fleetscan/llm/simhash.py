"""SimHash near-duplicates by covering locality-sensitive hashing (operator 5).

A fingerprint has a bit for the majority of the hashes of a text's word shingles.  For a
radius r, bit i gets a nonzero vector phi(i) of r+1 bits, and for each nonzero vector v
there is a table whose mask holds the bits with <phi(i), v> odd.  The vectors of at most
r differing bits span at most r dimensions, so some v is orthogonal to all of them, its
mask leaves out every differing bit, and the pair collides there: no pair is missed.

A bucket holds distinct fingerprints only.  Buckets of two are compared by expressions.
Larger ones are searched by spreading from member to member, which gives a spanning
forest of the links instead of all pairs.  Buckets over ``HOT_BUCKET`` are first divided
by covering masks over the bits that their table leaves free; then about 49 bits agree,
so a bucket has at most 2^16 members, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, fresh, join_classes, materialize, ship
from .graph import components

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Members of a bucket that are searched without dividing it further.
HOT_BUCKET = 4096
#: Fingerprints that a task puts into the tables, about.
SPREAD_ROWS = 100_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 without words."""
    # On bytes, lower() and split() treat A-Z, space and \\x09-\\x0D only.
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), words: int = SHINGLE_WORDS) -> DataFrame:
    """``keys`` and fp (the fingerprint as a signed long) of every row."""
    ship(docs.sparkSession)
    source = docs.select(*keys, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(b.schema.get_field_index("__text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(fps.view(np.int64))], names=[*keys, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return source.mapInArrow(run, f"{schema}, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """A mask over the given bit positions for each nonzero vector of radius+1 bits."""
    top = (1 << (radius + 1)) - 1
    phi = {b: i % top + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (phi[b] & v).bit_count() & 1) for v in range(1, top + 1)]


def signed(x: int) -> int:
    """A 64-bit pattern as Spark's signed long."""
    return x - (1 << 64) if x >> 63 else x


def link_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` that span what all links among distinct ``fps`` connect."""
    left = np.sort(fps.view(np.uint64))
    us, vs = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                us.append(np.full(len(found), x))
                vs.append(found)
                queue += list(found)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)


def _bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) in buckets (t, key) of bounded size; members has t, key and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            own = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            own = own if rest is None else np.concatenate([rest, own], axis=1)
            edges = np.flatnonzero((np.diff(own[:2], axis=1) != 0).any(axis=0)) + 1
            cut = [0, *edges.tolist()]
            yield _links_of([own[2, x:y] for x, y in zip(cut, cut[1:], strict=False)], radius)
            rest = own[:, cut[-1] :]
        if rest is not None:
            yield _links_of([rest[2]], radius)

    ordered = members.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    return ordered.mapInArrow(run, "u long, v long")


def _links_of(groups: list[np.ndarray], radius: int) -> pa.RecordBatch:
    found = [link_forest(np.unique(g), radius) for g in groups if len(g) > 1]
    u = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    v = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _in_tables(members: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """(t, key, fp): the bucket of each fingerprint in every table (number, mask)."""
    hits = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in tables))
    return members.select("fp", F.explode(hits).alias("b")).select("b.t", "b.key", "fp")


def near_links(fps: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fps`` (fp) that span all links within
    ``radius``: two are connected by them exactly if a chain of links joins them."""
    masks = covering_masks(list(range(64)), radius)
    tables = [(v + 1, m) for v, m in enumerate(masks)]
    # Few files of fingerprints make many rows of buckets.
    parts = max(-(-fps.count() // SPREAD_ROWS), fps.sparkSession.sparkContext.defaultParallelism)
    placed = _in_tables(fps.repartition(parts, "fp"), tables)
    shared = materialize(placed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    pairs = shared.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    members = placed.join(shared.where("n > 2").select("t", "key", "n"), ["t", "key"])
    links = pairs.unionByName(_bucket_links(members.where(F.col("n") <= hot_bucket), radius))
    if not shared.where(F.col("n") > hot_bucket).isEmpty():
        hot = materialize(members.where(F.col("n") > hot_bucket).select("t", "fp"), "hot")
        for t, m in tables:
            free = [b for b in range(64) if not m >> b & 1]
            finer = [(t * 1000 + w, m | x) for w, x in enumerate(covering_masks(free, radius))]
            links = links.unionByName(_bucket_links(_in_tables(hot.where(F.col("t") == t).select("fp"), finer), radius))
    return links


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key``, text_hash (64-bit hash of the text), fp, root (smallest fingerprint of the
    component) and component_id (smallest key in it, nulls aside) of every row.

    Null and empty texts have fingerprint 0 and are linked like others; repeated rows are
    in one component. An empty table gives no rows. Texts of any length are hashed whole;
    other columns are ignored. A fingerprint of very many rows (copies, texts without words)
    is one row until the end, where its rows get their class without being dealt by it.
    """
    table = materialize(fingerprints(docs.select(key, text, F.xxhash64(text).alias("__hash")), text, (key, "__hash"), words), "fingerprints")
    fps = materialize(table.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct")
    roots = materialize(components(near_links(fps.select("fp"), radius, hot_bucket)), "roots")
    members = roots.join(fps, roots["node"] == fps["fp"]).select("fp", "root", "least")
    named = materialize(members.groupBy("root").agg(F.min("least").alias("named")), "named")
    linked = members.select("fp", "root").join(named, "root")
    known = materialize(fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id")), "classes")
    return join_classes(table, known, "fp", "n", hot_rows).select(key, F.col("__hash").alias("text_hash"), "fp", "root", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of each near-duplicate component: that with the smallest key (of equal keys
    the smallest text hash), all columns kept. Of wholly equal rows one stays."""
    found = materialize(near_duplicates(docs.select(key, text), text, key, **options), "near")
    first = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "text_hash")).alias("x"))
    chosen = first.select("root", F.col("x.key").alias("__key"), F.col("x.text_hash").alias("__hash"))
    copies = found.groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__n"))
    picked = materialize(chosen.alias("a").join(copies.alias("b"), F.col("a.__key").eqNullSafe(F.col("b.__key")) & (F.col("a.__hash") == F.col("b.__hash"))).select("a.__key", "a.__hash", "__n").distinct(), "picked")
    a, h, n = fresh(docs, "__near_key"), fresh(docs, "__near_hash"), fresh(docs, "__near_n")
    picked = picked.toDF(a, h, n)
    kept = docs.join(picked, docs[key].eqNullSafe(picked[a]) & (F.xxhash64(docs[text]) == picked[h]))
    plain, repeated = kept.where(F.col(n) == 1), kept.where(F.col(n) > 1)
    return plain.select(*docs.columns).unionByName(repeated.select(*docs.columns).dropDuplicates([key, text]))
