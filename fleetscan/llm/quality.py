"""Quality classifier: a sparse rule ensemble (operator 6).

Small boosted trees over text statistics propose rules: each path from a root is a
conjunction of thresholds.  A lasso logistic regression over the rules keeps few of
them, and the kept rules are compiled into one Spark column expression over the
statistics.  The trees and the lasso are fitted here with numpy, on a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, materialize, ship

STATS = ("n_words", "mean_word", "distinct_share", "top_word_share", "same_as_last_share", "repeat_share", "symbol_share", "bar_share", "bang_share", "upper_share", "digit_share", "letter_share", "dup_line_share", "words_per_line", "capital_word_share")
#: Labelled rows that the model is fitted on, at most (about; rows are taken by hash).
MAX_TRAIN = 20_000
TREES, DEPTH, RATE, BINS, MIN_LEAF = 60, 3, 0.2, 32, 10
LASSO = 0.002
#: Documents that score less are rejected.
THRESHOLD = 0.3

_KEPT = {name: bytes(c for c in range(256) if c not in set(chars)) for name, chars in {"symbol": b"#*$%&<>@^~_=+{}[]\\", "bar": b"|", "bang": b"!", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789"}.items()}


def stats_of(text: str | None) -> tuple[float, ...]:
    """The statistics of one text; all 0 where there is no word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    count = {k: len(raw.translate(None, drop)) for k, drop in _KEPT.items()}
    chars = sum(map(len, words))
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = count["upper"] + count["lower"] + sum(c >= 0xC3 for c in raw.translate(None, bytes(range(128))))
    return (
        float(n),
        chars / n,
        len(seen) / n,
        max(seen.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(pairs) / max(1, n - 2) if n > 2 else 0.0,
        count["symbol"] / n,
        count["bar"] / n,
        count["bang"] / n,
        count["upper"] / max(1, count["upper"] + count["lower"]),
        count["digit"] / chars,
        letters / chars,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(map(bytes.isupper, words)) / n,
    )


def text_stats(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` (the text may be among them) and the columns of ``STATS`` (double) of every
    row."""
    ship(docs.sparkSession)
    kept = docs.select(*keys)
    name = text if text in keys else "__text"
    source = kept if text in keys else docs.select(*keys, F.col(text).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([stats_of(t.as_py()) for t in b.column(b.schema.get_field_index(name))], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), *(pa.array(got[:, i]) for i in range(len(STATS)))], names=[*keys, *STATS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return source.mapInArrow(run, schema + "".join(f", {s} double" for s in STATS))


#: A condition: statistic, whether it is at most (else over) a threshold.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """A bias and weighted conjunctions."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The probability of label 1, as an expression over the statistics' columns."""
        terms = [f"IF({' AND '.join(f'{s} {"<=" if low else ">"} {t!r}D' for s, low, t in rule)}, {w!r}D, 0D)" for rule, w in self.rules]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.bias!r}D', *terms])})))")


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, lasso: float = LASSO, seed: int = 7) -> RuleModel:
    """Fit on rows ``x`` with labels ``y``. No rows, or one label only, give the (smoothed)
    share of label 1 for every text."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return RuleModel(bias, ())
    rules = sorted(boosted_rules(x, y, bias, trees, depth, rate, seed))
    hits = np.stack([np.logical_and.reduce([(x[:, f] <= t) == low for f, low, t in r]) for r in rules], axis=1)
    useful = np.unique(hits, axis=1, return_index=True)[1]
    useful = [i for i in sorted(useful) if 0 < hits[:, i].mean() < 1]
    w, b = lasso_logistic(hits[:, useful].astype(np.float64), y, lasso)
    return RuleModel(float(b), tuple((tuple((names[f], low, float(t)) for f, low, t in rules[i]), float(w[k])) for k, i in enumerate(useful) if w[k]))


def boosted_rules(x, y, bias: float, trees: int, depth: int, rate: float, seed: int) -> set[tuple[tuple[int, bool, float], ...]]:
    """The paths of boosted trees, each fitted on a random half to the logistic gradient."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(k, c, "left") for k, c in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(len(y), bias)
    found: set[tuple[tuple[int, bool, float], ...]] = set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        used = rng.random(len(y)) < 0.5
        level = [(np.ones(len(y), bool), ())]
        for d in range(depth):
            following = []
            for rows, path in level:
                own = rows & used
                if own.sum() < 2 * MIN_LEAF or not (split := best_split(bins[own], grad[own], hess[own], cuts)):
                    margin[rows] += rate * leaf(grad[own], hess[own])
                    continue
                f, k = split
                t = float(cuts[f][k])
                for low in (True, False):
                    part, to = rows & ((bins[:, f] <= k) == low), tidy((*path, (f, low, t)))
                    found.add(to)
                    following.append((part, to))
                    if d == depth - 1:
                        margin[part] += rate * leaf(grad[part & used], hess[part & used])
            level = following
    return found


def tidy(path: tuple) -> tuple:
    """One bound for each side of a statistic, in order."""
    least: dict[tuple[int, bool], float] = {}
    for f, low, t in path:
        least[f, low] = t if (f, low) not in least else (min if low else max)(least[f, low], t)
    return tuple(sorted((f, low, t) for (f, low), t in least.items()))


def leaf(grad: np.ndarray, hess: np.ndarray) -> float:
    return float(np.clip(grad.sum() / (hess.sum() + 1.0), -4, 4))


def best_split(bins, grad, hess, cuts) -> tuple[int, int] | None:
    """(statistic, cut) of the largest gain with MIN_LEAF rows on both sides."""
    best, at = 1e-6, None
    whole = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f, k in enumerate(cuts):
        if not len(k):
            continue
        g, h, n = (np.cumsum(np.bincount(bins[:, f], v, len(k) + 1))[:-1] for v in (grad, hess, None))
        gain = g**2 / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - whole
        gain[(n < MIN_LEAF) | (len(grad) - n < MIN_LEAF)] = 0
        if gain.max() > best:
            best, at = gain.max(), (f, int(gain.argmax()))
    return at


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights and the free bias, by accelerated proximal gradient."""
    n, k = x.shape
    step = 4 * n / (np.linalg.norm(x, 2) ** 2 + n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, c, m = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(x @ u + c))) - y
        v = u - step * (x.T @ r) / n
        v = np.sign(v) * np.maximum(np.abs(v) - step * penalty, 0)
        d = c - step * r.mean()
        m2 = (1 + np.sqrt(1 + 4 * m * m)) / 2
        u, c = v + (m - 1) / m2 * (v - w), d + (m - 1) / m2 * (d - b)
        w, b, m = v, d, m2
    return w, b


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, text: str = "text", key: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    """Fit on labelled documents for which ``train_rows`` (a condition on the key) holds.

    About ``max_train`` keys at most are taken, by hash, so the sample and what reaches the
    driver (its statistics) are bounded. Null keys and labels aren't used; a key with
    several labels gets their majority; of several documents with a key that with the least
    text hash is used. Texts of any length are read whole.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & train_rows)
    each = known.groupBy(key).agg((F.avg(label) >= 0.5).cast("double").alias("__label"))
    total = each.count()
    sample = materialize(each.where(hash_fraction([F.col(key)], max_train / max(total, 1), "quality")), "labelled")
    # At most about max_train pairs of numbers, by the fraction above.
    rows = docs.select(key, text).join(F.broadcast(sample), key).withColumn("__hash", F.xxhash64(text))
    own = F.min(F.struct("__hash", "__label", *STATS)).alias("x")
    got = text_stats(rows, text, (key, "__label", "__hash")).groupBy(key).agg(own).orderBy(key).select("x.__label", *(f"x.{s}" for s in STATS)).toPandas().to_numpy(np.float64)
    return fit(got[:, 1:], got[:, 0])


def scored(docs: DataFrame, model: RuleModel, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the statistics and score of every row. Null and empty texts have all
    statistics 0 and are scored like others; other columns are ignored."""
    return text_stats(docs, text, keys).withColumn("score", model.score())


def keep_good(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, all columns kept. The text passes through
    the task that scores it, so nothing is joined."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = text_stats(docs.toDF(*names), names[docs.columns.index(text)], tuple(names))
    return rows.where(model.score() >= threshold).select(*names).toDF(*docs.columns)
