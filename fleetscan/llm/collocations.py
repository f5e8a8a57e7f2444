"""Collocated phrases by Toivonen's sampling algorithm (operator 13).

A sample of the documents proposes the frequent phrases of each language, with a lowered
threshold.  One pass over all documents then counts them and their negative border: every
phrase that isn't among them but whose parts (without its last, without its first word) are.
A phrase of the border that is frequent is one that the sample has missed.  The documents are
passed again for what the first pass left out and may yet be frequent, as none of its
counted parts is rare; that looks through all lengths at once, so the frequent phrases are
closed after it.

The first pass counts hashes of 80 bits in place of texts; the texts of those that are frequent
come from the sample, so that not each task has to give the text of each frequent phrase, which
would be rows by the product of both.  Hashes that the sample has no text for, or two, are counted by text
in the second pass, with what the first has left out.  That a phrase is added to a frequent one, as both
have one hash, has a chance of (phrases * frequent phrases) / 2^80: 10^-11 for a GB of text.  A task
finds out whether a phrase was proposed, seemed frequent, or lacks its text in a bit set of a fixed size by 64 of
these bits, whose false hits only add phrases to count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_fraction, materialize, ship
from .tokens import release_memory

#: Least occurrences and most words of a phrase; phrases returned for a language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Share of the documents that is the sample, and by how much its threshold is lowered.
SAMPLE, LOWERED = 1 / 16, 0.5
#: Bits of the set that a task gets (2 to this power), and bytes of text that it counts at once.
BITS, BLOCK_BYTES = 27, 4 << 20
#: Parts in which a language's phrases are ranked first.
PARTS = 64

#: In decimals of 37 digits, as the products may pass 64 bits.
SCORE = "CAST(1000 * a AS DECIMAL(18, 0)) * CAST(total AS DECIMAL(18, 0)) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"

_PIECE = re.compile(rb"[.,;:!?\n-\r]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: What a byte is: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but their last word and of that word."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _word_hashes(lang: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word."""
    seed = xxhash.xxh64_intdigest(lang) >> 1
    both = np.frombuffer(b"".join(xxhash.xxh128_digest(w, seed) for w in words), "<u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def _check(marks: np.ndarray) -> np.ndarray:
    """The 16 bits of a second hash that a phrase is told apart by besides its first."""
    return (marks >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(33)) & mask).astype(np.int64)


class BitSet:
    """Phrases, as bits of their hashes; empty without a table."""

    def __init__(self, blocks: np.ndarray | None, bits: int):
        self.blocks, self.bits = blocks, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.blocks is None:
            return np.zeros(len(hashes), bool)
        found = np.ones(len(hashes), bool)
        for at in _bits(hashes, self.bits):
            found &= (self.blocks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return found


def bit_set(hashes: DataFrame | None, bits: int) -> BitSet:
    """The set of the hashes ``h``. Its size depends on ``bits`` alone: Spark joins the bits of
    each block of 64, and at most 2^(bits-6) blocks come to the driver."""
    if hashes is None:
        return BitSet(None, bits)
    mask = F.lit((1 << bits) - 1)
    at = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 33).bitwiseAND(mask))).alias("at")
    found = hashes.select(at).groupBy(F.shiftright("at", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b")).toArrow()
    blocks = np.zeros(1 << max(bits - 6, 0), np.uint64)
    blocks[found.column("block").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return BitSet(blocks, bits)


def blocks_of(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, each up to the end of a piece."""
    at = 0
    while at < len(text):
        m = _PIECE.search(text, at + size)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


class Words:
    """The words of a block of one language, as codes, and where phrases of them may stand."""

    def __init__(self, lang: str, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        kind = _KIND[raw]
        word = kind == 0
        edges = np.diff(word.view(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.n = len(starts)
        bounds = np.zeros(self.n + 1, np.int32)
        np.cumsum(stops - starts, out=bounds[1:])
        coded = pa.StringArray.from_buffers(self.n, pa.py_buffer(bounds), pa.py_buffer(raw[word].tobytes())).dictionary_encode()
        self.dictionary, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.hashes, self.marks = _word_hashes(lang, self.dictionary.to_pylist())
        piece = np.cumsum(kind == 2)[starts]
        #: Whether a word and the next are of one piece.
        self.joined = piece[1:] == piece[:-1]

    def phrases(self, starts: np.ndarray, k: int) -> pa.Array:
        """The text of the phrases of k words from ``starts`` on."""
        return pc.binary_join_element_wise(*(self.dictionary.take(pa.array(self.codes[starts + i])) for i in range(k)), " ")

    def counted(self, known: BitSet, grown: BitSet | None, longest: int, shortest: int, told: BitSet | None) -> Iterator[tuple]:
        """Phrases (hashes, second hashes, texts) and their occurrences: those of ``known`` and its border;
        or, given ``grown`` (what seems frequent of those), the others whose parts aren't known
        to be rare and what is in both ``grown`` and ``told``. Texts are there given ``told`` alone."""
        size, codes = len(self.dictionary), self.codes
        ids, hashes, marks, run = codes, self.hashes, self.marks, np.ones(self.n, bool)
        if shortest == 1:
            n = np.bincount(codes, minlength=size)
            take = np.ones(size, bool) if grown is None else grown.has(hashes)
            if told is not None:
                take &= told.has(hashes)
            yield hashes[take], marks[take], self.dictionary.filter(pa.array(take)) if told else None, n[take]
        proposed = known.has(hashes)[codes]
        open_ = proposed if grown is None else grown.has(hashes)[codes]
        for k in range(2, min(longest, self.n) + 1):
            run = run[:-1] & self.joined[k - 2 :]
            may = open_[:-1] & open_[1:] & run
            starts = np.flatnonzero(may)
            if not len(starts):
                return
            before = (proposed[:-1] & proposed[1:])[starts]
            keys, first, inverse, n = np.unique(ids[starts] * size + codes[starts + k - 1], return_index=True, return_inverse=True, return_counts=True)
            left, right = keys // size, keys % size
            hashes, marks = _mixed(hashes[left], self.hashes[right]), _mixed(marks[left], self.marks[right])
            seems = np.ones(len(n), bool) if grown is None else grown.has(hashes)
            take = np.ones(len(n), bool) if grown is None else ~before[first]
            if grown is not None and told is not None:
                take |= seems & told.has(hashes)
            if k >= shortest and take.any():
                yield hashes[take], marks[take], self.phrases(starts[first[take]], k) if told else None, n[take]
            ids = np.zeros(len(may), np.int64)
            ids[starts] = inverse
            proposed, open_ = np.zeros(len(may), bool), np.zeros(len(may), bool)
            proposed[starts] = before & known.has(hashes)[inverse]
            open_[starts] = proposed[starts] if grown is None else ~before | seems[inverse]


def _of_langs(b: pa.RecordBatch, block_bytes: int) -> Iterator[tuple[str, Words]]:
    """Blocks of words of each language of a batch (lang, text)."""
    for lang in pc.unique(b.column(0)).to_pylist():
        own = b.column(1).filter(pc.equal(b.column(0), lang))
        text = "\n".join(own.to_pylist()).encode("utf-8", "surrogatepass").translate(_LOWER)
        for part in blocks_of(text, block_bytes):
            words = Words(lang, part)
            if words.n:
                yield lang, words


def hash_counts(docs: DataFrame, known: BitSet, grown: BitSet | None = None, longest: int = LONGEST, shortest: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(h, c, n) of the phrases that :meth:`Words.counted` gives, over all of ``docs`` (lang, text);
    h and c are the 80 bits that stand for a phrase.

    A task counts a batch first, block by block, so a phrase of very many occurrences is a row
    for each batch.
    """
    ship(docs.sparkSession)
    sets = docs.sparkSession.sparkContext.broadcast((known, grown))  # 2^bits bits each, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, grown = sets.value
        for b in batches:
            found = [(h, _check(g), n) for _, words in _of_langs(b, block_bytes) for h, g, _, n in words.counted(known, grown, longest, shortest, None)]
            if found:
                h, c, n = (np.concatenate([x[i] for x in found]) for i in (0, 1, 2))
                del found
                order = np.argsort(h)
                h, c, n = h[order], c[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[first]), pa.array(np.add.reduceat(n, first))], names=["h", "c", "n"])
            release_memory()

    # Dealt out first: summing once more before that would hold a task's rows and hardly find two of a phrase.
    return docs.mapInArrow(run, "h long, c short, n long").repartition("h", "c").groupBy("h", "c").agg(F.sum("n").alias("n"))


def texts_of(docs: DataFrame, wanted: BitSet, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(h, c, lang, phrase) of the phrases of ``wanted``, of which all parts are wanted too, that are in ``docs``;
    only what has one text there."""
    ship(docs.sparkSession)
    sets = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sets.value
        for b in batches:
            found: list[pa.Table] = []
            for lang, words in _of_langs(b, block_bytes):
                for h, g, phrases, _ in words.counted(wanted, wanted, longest, 1, wanted):
                    found.append(pa.table([h.view(np.int64), _check(g), pa.repeat(lang, len(h)), phrases], names=["h", "c", "lang", "phrase"]))
            if found:
                once = pa.concat_tables(found).group_by(["h", "c", "lang", "phrase"]).aggregate([])
                found.clear()
                yield from once.select(["h", "c", "lang", "phrase"]).to_batches()
            release_memory()

    text = F.struct("lang", "phrase")
    each = docs.mapInArrow(run, "h long, c short, lang string, phrase string").groupBy("h", "c").agg(F.min(text).alias("t"), F.max(text).alias("other"))
    return each.where("t = other").select("h", "c", "t.lang", "t.phrase")


def text_counts(docs: DataFrame, known: BitSet, grown: BitSet, told: BitSet, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, n) of what seems frequent (``grown``) and is in ``told``, and of what may be frequent
    besides; n of all words as the phrase ""."""
    ship(docs.sparkSession)
    sets = docs.sparkSession.sparkContext.broadcast((known, grown, told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, grown, told = sets.value
        for b in batches:
            found: list[pa.Table] = []
            for lang, words in _of_langs(b, block_bytes):
                for _, _, phrases, n in ((None, None, pa.array([""]), np.array([words.n])), *words.counted(known, grown, longest, 1, told)):
                    found.append(pa.table([pa.repeat(lang, len(n)), phrases, pa.array(n, pa.int64())], names=["lang", "phrase", "n"]))
            if found:
                summed = pa.concat_tables(found).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
                found.clear()
                yield from summed.select(["lang", "phrase", "n"]).to_batches()
            release_memory()

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def proposed(sample: DataFrame, least: int, longest: int, bits: int) -> BitSet:
    """What occurs ``least`` times in the sample: words, then pairs of those, then all longer
    phrases whose pairs do."""
    words = materialize(hash_counts(sample, bit_set(None, bits), longest=1).where(F.col("n") >= least).select("h"), "sample-words")
    one = bit_set(words, bits)
    pairs = materialize(hash_counts(sample, one, longest=2, shortest=2).where(F.col("n") >= least).select("h"), "sample-pairs")
    both = words.unionByName(pairs)
    longer = hash_counts(sample, one, bit_set(both, bits), longest, 3).where(F.col("n") >= least).select("h")
    return bit_set(both.unionByName(longer), bits)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: float = SAMPLE, lowered: float = LOWERED, key: str = "key", bits: int = BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, n) of all phrases with n >= ``least``, and n of all words as phrase "".

    ``docs`` has lang, text (neither null) and ``key``, whose hash decides whether a document is in
    the sample. The sample and its threshold decide what is counted in which pass and where texts
    come from, never what returns: with an empty sample the last pass counts all by text. It needs
    no other after it: each counted part of a frequent phrase seems frequent, so the phrase is counted.
    """
    sample = materialize(docs.where(hash_fraction([F.col(key)], share, "phrases")).select("lang", "text"), "sample")
    known = proposed(sample, max(1, int(least * share * lowered)), longest, bits)
    texts = docs.select("lang", "text")
    often = materialize(hash_counts(texts, known, None, longest, 1, block_bytes).where(F.col("n") >= least), "often")
    grown = bit_set(often.select("h"), bits)
    named = materialize(often.join(texts_of(sample, grown, longest, block_bytes), ["h", "c"], "left"), "named")
    told = bit_set(named.where("phrase IS NULL").select("h"), bits)
    rest = text_counts(texts, known, grown, told, longest, block_bytes).where((F.col("n") >= least) | (F.col("phrase") == ""))
    # What the bits of ``told`` hit by chance is in both.
    both = named.where("phrase IS NOT NULL").select("lang", "phrase", "n").unionByName(rest)
    return materialize(both.groupBy("lang", "phrase").agg(F.min("n").alias("n")), "frequent")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", least: int = LEAST, longest: int = LONGEST, top: int = TOP, **how) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A null lang is ``und``, a null text empty. A text of any length is counted whole, block by
    block between pieces. Ties are in the order a (descending), phrase (bytes). Repeated documents
    count as often as they are there. Without phrases of ``least`` occurrences, as in an empty
    table, there are no rows. Other columns are dropped, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(key).alias("key"))
    all_ = frequent(rows, least, longest, key="key", **how)
    totals = all_.where("phrase = ''").select("lang", F.col("n").alias("total"))
    known = all_.where("phrase <> ''").withColumn("words", F.split("phrase", " "))
    part = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    several = known.where(F.size("words") > 1)
    inner = lambda x, begin, n: F.array_join(F.slice(x, begin, n), " ")
    longer = known.where(F.size("words") > 2).select("lang", F.explode(F.array(inner("words", F.lit(1), F.size("words") - 1), inner("words", F.lit(2), F.size("words") - 1))).alias("phrase"), "n").distinct()
    # A longer phrase has at most as many occurrences, and one with as many has one by one word longer.
    kept = several.join(longer, ["lang", "phrase", "n"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", inner("words", F.lit(1), F.col("k")).alias("left"), inner("words", F.col("k") + 1, F.size("words")).alias("right"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(totals, "lang")
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("b"))
    scored = best.select("lang", "phrase", "b.a", "b.l", "b.r", F.col("b.total").alias("n"), "b.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    near = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
