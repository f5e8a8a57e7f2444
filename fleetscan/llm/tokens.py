"""Tokenizing with the ``tokenizers`` library behind a per-worker cache of text runs.

A byte-level BPE pre-tokenizer never joins characters across a single space that has a
non-space character on both sides: the run to the left ends there, and the space opens
the next run.  So a text is cut at such spaces, each distinct run is encoded by the
library once per worker, and a document's ids are the concatenation of its runs' ids.
Runs that are one word, or a word and ASCII punctuation after it, go to the same BPE
model without the library's general pre-tokenizer, which halves their cost.  Results
are those of encoding the whole text; tests compare the two.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Runs kept per Python worker. A full cache takes no more; frequent runs come first.
CACHE_RUNS = 300_000
#: Runs longer than this are encoded but not kept.
CACHE_CHARS = 48

_CUT = re.compile(r"(?<=\S) (?=\S)")
_WORD_TAIL = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")
_ENCODERS: dict[str, "RunEncoder"] = {}


def default_tokenizer() -> str:
    """Path of the default vocabulary file, given by the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "RunEncoder":
    """The worker's encoder for a vocabulary file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
    return _ENCODERS[path]


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + len(names) - len(plain))
    return [names[b] for b in range(256)]


def joined(parts: list[bytes], index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Parts of little-endian ids (those that ``index`` names, in its order), one after
    another, and their bounds in ids."""
    pool = pa.array(parts, pa.large_binary())
    laid = pool if index is None else pool.take(pa.array(index))
    if not len(laid):
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    bounds = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1) >> 2
    return np.frombuffer(laid.buffers()[2] or b"", "<u4", int(bounds[-1])), bounds


def strings(words: pa.Array) -> list[str]:
    """A list of words without a space in them, by one join and split."""
    if not len(words):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(one, " ")[0].as_py().split(" ")


def release_memory() -> None:
    """Give Arrow's unused memory back, as a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()


def encode_column(batch: pa.RecordBatch, column: str, path: str, end_id: int | None, block_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of a batch with their ids and bounds, ``end_id`` after each text's ids.

    A block holds about ``block_bytes`` of text (or one longer text), which bounds the
    memory of a task.
    """
    enc = encoder(path)
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, base + block_bytes, "right")))
        part = batch.slice(at, stop - at)
        yield part, *enc.encode(part.column(part.schema.get_field_index(column)), end_id)
        at = stop
    release_memory()


class RunEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        pre = form.get("pre_tokenizer") or {}
        self.by_runs = form.get("normalizer") is None and form["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex"))
        self.after_space: dict[str, bytes | None] = {}
        self.general: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        if self.by_runs:
            names = byte_alphabet()
            self.letters = {b: names[b] for b in range(128, 256)}
            self.mark = names[32]
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            vocab = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.opens[[i for t, i in vocab.items() if t.startswith(self.mark)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the library's whole pipeline."""
        return [x.tobytes() for x in self._ids(self.tokenizer, texts)]

    @staticmethod
    def _ids(by, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. The library's results are large, so few are held at once."""
        for at in range(0, len(texts), 256):
            for e in by.encode_batch_fast(texts[at : at + 256], add_special_tokens=False):
                yield np.asarray(e.ids, dtype="<u4")

    def encode(self, texts: list[str | None] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each followed by ``end_id``, and where each
        text's begin (and the last's end); null counts as empty.

        Texts are cut into runs and the runs reduced to distinct ones by Arrow, so Python
        sees each distinct run of a batch once.
        """
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if not self.by_runs:
            return joined([x + end for x in self.whole(texts.to_pylist())])
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        index, runs = coded.indices.to_numpy().copy(), strings(coded.dictionary)
        found = list(map(self.after_space.get, runs))
        missing = [r for r, x in zip(runs, found, strict=True) if x is None]
        if missing:
            got = self._learn(missing)
            found = [got.get(r) if x is None else x for r, x in zip(runs, found, strict=True)]
        first = bounds[:-1]
        heads = [runs[i] for i in index[first].tolist()]
        plain = self._pipeline(set(heads))
        # The first run of each text has no space before it.
        index[first] = len(runs) + np.arange(len(first), dtype=index.dtype)
        awkward = [i for i, x in enumerate(found) if x is None]
        values = [*found, *(plain[h] for h in heads)]
        if awkward:
            bad = np.zeros(len(values), bool)
            bad[awkward] = True
            for i in awkward:
                values[i] = b""
            for i in np.flatnonzero(np.logical_or.reduceat(bad[index], first)).tolist():
                # Runs beside more white space, which may join it: the text is cut with care.
                more = _CUT.split(texts[i].as_py())
                keys = [more[0], *(" " + r for r in more[1:])]
                index[bounds[i] : bounds[i + 1]] = len(values)
                index[bounds[i] + 1 : bounds[i + 1]] += 1
                values += [b"".join(map(self._pipeline(set(keys)).__getitem__, keys)), b""]
        if end:
            index = np.insert(index, bounds[1:], len(values))
            values.append(end)
            bounds = bounds + np.arange(len(bounds))
        ids, at = joined(values, index)
        return ids, at[bounds]

    def _pipeline(self, runs: set[str]) -> dict[str, bytes]:
        """Runs as they are, by the whole pipeline."""
        fresh = list(runs - self.general.keys())
        if not fresh:
            return self.general
        got = dict(zip(fresh, self.whole(fresh), strict=True))
        return self._keep(self.general, got)

    def _learn(self, fresh: list[str]) -> dict[str, bytes | None]:
        """Runs with a space before them; None for those that may join white space."""
        got: dict[str, bytes | None] = {}
        words, tailed, other = [], [], []
        for r in fresh:
            if r.isalpha():
                words.append(r)
            elif not r or r[0].isspace() or r[-1].isspace():
                got[r] = None
            elif m := _WORD_TAIL.fullmatch(r):
                tailed.append((r, *m.groups()))
            else:
                other.append(r)
        known = set(words)
        stems = list({s for _, s, _ in tailed if s not in self.after_space and s not in known})
        if words or stems:
            got |= self._split(self.words, words + stems, [self.mark + (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)) for w in words + stems], "")
        if tailed:
            tails = list({t for _, _, t in tailed} - self.tails.keys())
            ends = dict(zip(tails, self.whole(tails), strict=True)) if tails else {}
            for r, s, t in tailed:
                got[r] = (got[s] if s in got else self.after_space[s]) + (ends[t] if t in ends else self.tails[t])
            self._keep(self.tails, ends)
        if other:
            got |= self._split(self.tokenizer, other, other, " ")
        self._keep(self.after_space, got)
        return got

    def _split(self, by, runs: list[str], coded: list[str], head: str, group: int = 64) -> dict[str, bytes]:
        """Ids of runs, each with a space before it, many to a call. A run has no space
        within it, so a token that opens with the space's mark opens a run."""
        ids = np.concatenate(list(self._ids(by, [head + " ".join(coded[i : i + group]) for i in range(0, len(coded), group)])))
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(runs):  # a vocabulary without the usual alphabet
            return dict(zip(runs, self.whole([" " + r for r in runs]), strict=True))
        raw, at = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
        return {r: raw[a:b] for r, a, b in zip(runs, at, at[1:], strict=False)}

    @staticmethod
    def _keep(cache: dict, got: dict) -> dict:
        """Add to a cache with room, and return what holds both."""
        if len(cache) + len(got) <= CACHE_RUNS and all(len(k) <= CACHE_CHARS for k in got):
            cache.update(got)
            return cache
        room = CACHE_RUNS - len(cache)
        both = _Both(got, cache)
        if room > 0:
            cache.update([kv for kv in got.items() if len(kv[0]) <= CACHE_CHARS][:room])
        return both


class _Both:
    """Lookup in a batch's runs, then in the cache."""

    def __init__(self, got: dict, cache: dict):
        self.got, self.cache = got, cache

    def __getitem__(self, key: str):
        x = self.cache.get(key, self)
        return self.got[key] if x is self else x
