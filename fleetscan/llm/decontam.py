"""Benchmark decontamination with one Aho-Corasick automaton (operator 2).

Both sides are normalised to lower-case words (A-Z only) between single spaces.  The
patterns are windows of consecutive benchmark words with a space at both ends, so one
pass over a text finds every occurrence at word bounds.  Word places map the hits back
to offsets of the original text, as normalising keeps the words' order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, ship

#: Consecutive words of a window; a shorter item is one window.
WINDOW_WORDS = 10
#: Characters of the patterns in one automaton (about 30 bytes of memory each). More
#: patterns are scanned for in several passes.
MAX_PATTERN_CHARS = 8 << 20

#: The word class is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: on UTF-8
#: bytes, digits, a-z and all bytes from 0x80.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; none for null."""
    return (text or "").encode().translate(_WORDS).split()


def item_windows(items: DataFrame, text: str = "text", key: str = "item_id", words: int = WINDOW_WORDS) -> DataFrame:
    """(pattern, item): the distinct windows of each item, with the item's id as text. Null
    texts and texts without words give none; a null id reads "null"."""
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(t)
                for at in range(max(1, len(w) - words + 1) if w else 0):
                    out.append((b" " + b" ".join(w[at : at + words]) + b" ").decode("latin-1"))
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ids, pa.string())], names=["pattern", "item"])

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "pattern string, item string").distinct()


_AUTOMATA: dict[str, object] = {}


def _automaton(shared: Broadcast):
    """The automaton of a broadcast pattern list, built once per worker."""
    import ahocorasick

    name, patterns = shared.value
    if name not in _AUTOMATA:
        a = ahocorasick.Automaton()
        for i, (p, _) in enumerate(patterns):
            a.add_word(p, (i, p.count(" ") - 1))
        if patterns:
            a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = a
    return _AUTOMATA[name], patterns


def scan(docs: DataFrame, patterns: Broadcast, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, n_words, hit_from and hit_to (merged ranges of hit words, the end
    exclusive), char_from and char_to (their offsets in the original text) and items
    (sorted ids) of every row."""
    ship(docs.sparkSession)
    source = docs.select(*keys, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(patterns)
        for b in batches:
            out = [find(t.as_py(), automaton, known) for t in b.column(b.schema.get_field_index("__text"))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keys, *SPANS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return source.mapInArrow(run, f"{schema}, n_words long, hit_from array<long>, hit_to array<long>, char_from array<long>, char_to array<long>, items array<string>")


SPANS = ("n_words", "hit_from", "hit_to", "char_from", "char_to", "items")


def find(text: str | None, automaton, known) -> tuple[int, list[int], list[int], list[int], list[int], list[str]]:
    """What :func:`scan` returns for one text."""
    words = words_of(text)
    if not words or not known:
        return len(words), [], [], [], [], []
    line = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(line.decode("latin-1")))
    if not hits:
        return len(words), [], [], [], [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    stops = np.searchsorted(spaces, np.fromiter((e for e, _ in hits), np.int64, len(hits)))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, stops - np.fromiter((k for _, (_, k) in hits), np.int64, len(hits)), 1)
    np.add.at(step, stops, -1)
    hit = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    first, end = edges[::2].tolist(), edges[1::2].tolist()
    found = [m.span() for m in _WORD.finditer(text)]
    items = sorted(set().union(*(known[i][1] for i in {i for _, (i, _) in hits})))
    return len(words), first, end, [found[a][0] for a in first], [found[b - 1][1] for b in end], items


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", words: int = WINDOW_WORDS, max_chars: int = MAX_PATTERN_CHARS) -> DataFrame:
    """``key``, n_words, n_hit, the hit ranges (words and offsets), items and contaminated
    of every row.

    Null texts have no words; an item without words matches nothing; with no items at all
    no row is hit. Rows that repeat are each returned. Texts of any length are scanned
    whole. Other columns are ignored.

    The patterns' size is counted before they are broadcast. Beyond ``max_chars`` they are
    split over several automata, which scan the texts one after another. The items' ids
    travel with the patterns up to the same size; beyond it (a window may be in millions of
    items) the windows' numbers do, and the ids are joined to the rows that were hit.
    """
    spark = docs.sparkSession
    pairs = materialize(item_windows(items, item_text, item_key, words), "windows")
    if (pairs.agg(F.sum(F.length("item"))).first()[0] or 0) <= max_chars:
        return _scanned(docs, pairs.groupBy("pattern").agg(F.collect_set("item").alias("items")), text, key, max_chars)
    table = materialize(pairs.select("pattern").distinct().withColumn("items", F.array(F.monotonically_increasing_id().cast("string"))), "patterns")
    links = materialize(pairs.join(table, "pattern").select(F.element_at("items", 1).alias("number"), "item"), "links")
    found = _scanned(docs, table, text, key, max_chars)
    row = fresh(found, "__number")
    rows = materialize(found.withColumn(row, F.monotonically_increasing_id()), "hit-windows")
    hits = rows.select(row, F.explode("items").alias("number")).join(links, "number").groupBy(row).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.drop("items").join(hits, row, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).select(*found.columns)


def _scanned(docs: DataFrame, table: DataFrame, text: str, key: str, max_chars: int) -> DataFrame:
    """:func:`contamination` by the windows of ``table`` (pattern, items)."""
    spark = docs.sparkSession
    table = materialize(table, "patterns")
    total = table.agg(F.sum(F.length("pattern"))).first()[0] or 0
    shards = -(-total // max_chars) or 1
    parts = []
    for s in range(shards):
        own = table.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == s) if shards > 1 else table
        rows = [(r["pattern"], r["items"]) for r in own.toLocalIterator()]
        name = hashlib.sha256("\n".join(sorted(p for p, _ in rows)).encode()).hexdigest()
        shared = spark.sparkContext.broadcast((name, rows))
        if shards == 1:
            return _result(scan(docs, shared, text, (key,)), key)
        rows = scan(docs.select(key, text, F.xxhash64(text).alias("__hash")), shared, text, (key, "__hash"))
        # Equal keys with equal texts have equal results: one row stands for them.
        parts.append(materialize(rows if not s else rows.where(F.size("items") > 0), "scan"))
        shared.unpersist()
    return _merged(parts, docs, text, key)


def _result(found: DataFrame, key: str) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(key, "n_words", n_hit.alias("n_hit"), *SPANS[1:], (n_hit > 0).alias("contaminated"))


def _merged(parts: list[DataFrame], docs: DataFrame, text: str, key: str) -> DataFrame:
    """Several passes' ranges and items as one; a word that several hit counts once."""
    found = reduce(DataFrame.unionByName, parts).dropDuplicates()
    # Ranges as (word, offset) pairs; those that touch or overlap grow together.
    ranges = F.flatten(F.collect_list(F.transform(F.arrays_zip("hit_from", "hit_to", "char_from", "char_to"), lambda r: F.struct(r["hit_from"].alias("a"), r["hit_to"].alias("b"), r["char_from"].alias("c"), r["char_to"].alias("d")))))
    empty = F.lit(None).cast("array<struct<a:bigint,b:bigint,c:bigint,d:bigint>>")

    def grow(acc, r):
        last = F.element_at(acc, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"), last["c"].alias("c"), F.greatest(last["d"], r["d"]).alias("d"))
        return F.when(F.size(acc) == 0, F.array(r)).when(last["b"] >= r["a"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    merged = found.groupBy(key, "__hash").agg(F.max("n_words").alias("n_words"), F.array_sort(ranges).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("r", F.aggregate("r", F.coalesce(empty, F.array().cast("array<struct<a:bigint,b:bigint,c:bigint,d:bigint>>")), grow))
    flat = merged.select(F.col(key).alias("__key"), "__hash", "n_words", *(F.col(f"r.{f}").alias(n) for f, n in zip("abcd", SPANS[1:5], strict=True)), "items")
    rows = docs.select(key, F.xxhash64(text).alias("__row"))
    joined = rows.join(flat, rows[key].eqNullSafe(flat["__key"]) & (rows["__row"] == flat["__hash"]))
    return _result(joined.select(key, *SPANS), key)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without any hit window, all columns kept."""
    row = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    found = contamination(docs.select(row.alias("__row"), F.col(text).alias("__body")), items, "__body", "__row", **options)
    name = fresh(docs, "__hit_row")
    hit = materialize(found.where("contaminated").select(F.col("__row").alias(name)).distinct(), "hit")
    return docs.join(hit, docs[key].eqNullSafe(hit[name]["key"]) & (F.xxhash64(docs[text]) == hit[name]["hash"]), "left_anti")
