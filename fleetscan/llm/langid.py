"""Language identification by nearest centroids (operator 3).

A text is a vector of hashed 1- to 3-grams of its letters (others count as spaces), log
counts times inverse document frequency, at unit length.  Each language has several
centroids from spherical k-means; the nearest by cosine decides.  A text further from it
than the centroid's own members are is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, ship

#: Hash buckets of the n-grams, and n.
BUCKETS, GRAMS = 8192, 3
#: Centroids a language, and texts a language that k-means is fitted on (about, by hash).
CENTROIDS, MAX_TRAIN = 6, 400
#: Share of a language's texts that a centroid has at least.
LEAST_SHARE = 0.04
#: Languages that are learned at most, the most frequent ones (junk codes are rare); a model
#: has CENTROIDS * BUCKETS numbers for each.
MAX_LANGUAGES = 300
#: A text is rejected below this share of its centroid's least typical members' cosine.
REJECT = 0.7
UNKNOWN = "und"

_BMP = None


def letters_of(text: str | None) -> np.ndarray | None:
    """Code points, lower case, spaces for what isn't a letter; None without letters."""
    global _BMP
    if _BMP is None:
        _BMP = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _BMP[np.minimum(codes, 0xFFFF)]
    if codes.max() > 0xFFFF:
        far = codes > 0xFFFF
        known[far] = [chr(c).isalpha() for c in codes[far]]
    return np.where(known, codes, 32).astype(np.uint64) if known.any() else None


def gram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """How often each bucket's n-grams occur in one text; None without letters."""
    codes = letters_of(text)
    if codes is None:
        return None
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    total = np.zeros(buckets, np.int64)
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(GRAMS):
        mixed = (mixed[: len(codes) - n] * np.uint64(0x9E3779B97F4A7C15) + codes[n:] + np.uint64(n + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        real = codes[n:] != 32 if n == 0 else (codes[n:] != 32) | (codes[: len(codes) - n] != 32)
        total += np.bincount((mixed[real] >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return total


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts with letters, and which those are."""
    counts = [gram_counts(t, len(idf)) for t in texts]
    has = np.array([c is not None for c in counts], bool)
    if not has.any():
        return np.zeros((0, len(idf)), np.float32), has
    v = np.log1p(np.stack([c for c in counts if c is not None]).astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), has


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray


def document_frequency(docs: DataFrame, text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the texts; all rows, summed in the tasks."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for t in b.column(0):
                c = gram_counts(t.as_py(), buckets)
                if c is not None:
                    seen += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets)), pa.array(np.concatenate([[n], seen]))], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets + 1, np.int64)
    for r in rows:
        out[r["bucket"] + 1] = r["n"]
    return out[1:], int(out[0])


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out seeds: centroids, and the cosine that nearly all
    (98 %) members of each reach."""
    seeds = [int(np.argmax(v @ v.mean(axis=0)))]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)) and near.min() < 0.999:
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = v[own == i].mean(axis=0)
                c[i] = m / max(float(np.linalg.norm(m)), 1e-12)
    # Seeds may be stray texts: a centroid that few members chose is dropped.
    size = np.bincount(np.argmax(v @ c.T, axis=1), minlength=len(c))
    c = c[size >= min(size.max(), max(2, LEAST_SHARE * len(v)))]
    cos = v @ c.T
    own = np.argmax(cos, axis=1)
    return c, np.array([np.quantile(cos[own == i, i], 0.02) if (own == i).any() else 0.0 for i in range(len(c))])


def train(docs: DataFrame, train_rows: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", centroids: int = CENTROIDS, max_train: int = MAX_TRAIN, max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Fit on rows with a language for which ``train_rows`` holds; None without any.

    Of more than ``max_languages`` values the most frequent are learned, of equally frequent
    ones the first in order. Document frequencies cover all these rows; the centroids of a language come from about
    ``max_train`` of its texts, taken by hash, in one task a language.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & train_rows).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not sizes:
        return None
    df, n = document_frequency(known, "text")
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    taken = F.lit(False)
    for name, size in sizes.items():
        taken = F.when(F.col("lang") == name, hash_fraction([F.col("key"), F.xxhash64("text")], max_train / size, "lang")).otherwise(taken)

    def of_one(rows: pd.DataFrame) -> pd.DataFrame:
        v, _ = vectors(rows["text"].tolist(), idf)
        c, floor = cluster(v, centroids) if len(v) else (np.zeros((0, len(idf)), np.float32), np.zeros(0))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]] * len(c), "floor": floor, "centroid": [x.astype(np.float32) for x in c]})

    # Repeated rows count once, so a key or text that repeats without end can't fill the sample.
    rows = known.where(taken).dropDuplicates(["key", "text"]).groupBy("lang").applyInPandas(of_one, "lang string, floor double, centroid array<float>").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["centroid"]))
    if not rows:
        return None
    return LanguageModel(idf, [r["lang"] for r in rows], np.array([r["centroid"] for r in rows], np.float32), np.array([r["floor"] for r in rows]))


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, lang_pred, score (cosine with the nearest centroid) and rejected (further
    from it than its members are) of every row.

    Null texts and those without letters, and all texts without a model, are "und" with
    score 0 and rejected. Equal cosines go to the first language in order. Texts
    of any length are counted whole; other columns are ignored.
    """
    ship(docs.sparkSession)
    source = docs.select(*keys, docs[text].alias("__text"))
    # The model: at most MAX_LANGUAGES * CENTROIDS * BUCKETS floats.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                names, score, far = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
                if m is not None:
                    v, has = vectors(b.column(b.schema.get_field_index("__text")).to_pylist(), m.idf)
                    cos = v @ m.centroids.T
                    best = np.argmax(cos, axis=1) if len(v) else np.zeros(0, np.int64)
                    top = cos[np.arange(len(v)), best]
                    score[has] = np.clip(top, 0, 1)
                    far[has] = top < REJECT * m.floors[best]
                    for i, k in zip(np.flatnonzero(has).tolist(), best.tolist(), strict=True):
                        names[i] = m.languages[k]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(names, pa.string()), pa.array(score), pa.array(far)], names=[*keys, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
