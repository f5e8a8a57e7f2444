"""Rule bitmask ledger (operator 9).

Every rule is evaluated once for each document; the ledger keeps the measurements and
one bit for each failed rule.  Policies are versioned masks over those bits, so applying
a policy, comparing versions or removing a rule reads the ledger and never the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
_SYMBOL = re.compile("[#*$%&|<>]")
_UPPER = bytes(range(65, 91))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text; null has none of anything.

    Words are runs without space and \\x09-\\x0D. n_repeat_words counts the words inside
    5-word windows that occur twice or more, first occurrences too. n_dup_lines counts
    lines with a word that equal an earlier line. n_upper and n_letters count cased ASCII.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = upper + len(raw) - len(raw.translate(None, _UPPER.lower()))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, letters


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words covered by windows that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Equal windows get equal numbers: pairs of numbers are renumbered, so nothing is hashed.
    code, width = ids, 1
    while width < window:
        step = min(width, window - width)
        both = code[: len(code) - step] * (int(code.max()) + 1) + code[step:]
        code = np.unique(both, return_inverse=True)[1]
        width += step
        if len(code) and code.max() + 1 == len(code):
            return 0
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    step[at] += 1
    np.subtract.at(step, at + window, 1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def measurements(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and the columns of ``MEASURES`` (long) of every row."""
    ship(docs.sparkSession)
    source = docs.select(*keys, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([measure(t.as_py()) for t in b.column(b.schema.get_field_index("__text"))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), *(pa.array(got[:, i]) for i in range(len(MEASURES)))], names=[*keys, *MEASURES])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return source.mapInArrow(run, schema + "".join(f", {m} long" for m in MEASURES))


#: Rules in the order of their bits: name and what fails it.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("upper_case", "n_letters >= 20 AND 100 * n_upper > 50 * n_letters"),
)


def mask(*names: str) -> int:
    """The bits of the named rules."""
    place = {n: i for i, (n, _) in enumerate(RULES)}
    return sum(1 << place[n] for n in names)


#: Policies by version: which failed rules reject a document.
POLICIES: dict[str, int] = {
    "v1": mask("few_words", "repeated_windows"),
    "v2": mask("few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case"),
    "v3": mask("few_words", "repeated_windows", "symbols", "duplicate_lines", "upper_case", "long_words", "short_words"),
}


def ledger(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``keys``, the measurements and failures (long; bit i is set if rule i fails).

    Null and empty texts measure 0 everywhere and fail few_words. Rows that repeat have
    equal entries. Other columns are ignored.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measurements(docs, text, keys).withColumn("failures", failed)


def passes(version: str, policies: dict[str, int] = POLICIES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(policies[version])) == 0


def ablations(entries: DataFrame, version: str, rules: tuple[tuple[str, str], ...] = RULES, policies: dict[str, int] = POLICIES) -> DataFrame:
    """For each rule of a policy: failed, sole (rejected by this rule alone, so kept without
    it) and kept under the whole policy. The ledger is first counted by failure bits, of
    which there are few, and rules are compared on the counts."""
    own = policies[version]
    counts = entries.groupBy(F.col("failures").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = counts.select("bits", "n", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(rules) if own >> i & 1))).alias("r"))
    return per_rule.groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("sole"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"),
    )
