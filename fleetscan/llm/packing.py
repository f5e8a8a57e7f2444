"""Hierarchical multi-length packing (operator 1).

Documents are cut into full windows of the largest tier and a remainder.  A remainder
is routed to the smallest tier that holds it; tiers are packed from the longest to the
shortest; a window's gap is filled from shorter tiers, best fit first, and what then is
missing is cut from the shortest remainder that is too long.  Windows are dealt to step
groups of equal tokens, balanced by attention cost (the sum of squared piece lengths).

Each task packs the documents that it reads: no text is shuffled and no document waits
for another task.  A task's rest, under one window, is cut at powers of two, so that no
window needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ship
from .tokens import default_tokenizer, encode_column, release_memory

#: Context sizes, ascending powers of two.
TIERS = (128, 256, 512, 1024)
#: Tokens of a step group.
STEP_TOKENS = 8192
#: Remainders that a task packs at once; a rest under one window goes to the next block.
BLOCK_ROWS = 20_000
#: Tokens after which a task packs, however few its remainders.
BLOCK_TOKENS = 4_000_000

_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("capacity", pa.int32()), ("step_id", pa.int64())]


class Shelf:
    """Remainders by length, with the longest that fits found in a bit set."""

    def __init__(self, top: int):
        self.by: list[list] = [[] for _ in range(top + 1)]
        self.present = 0

    def put(self, n: int, piece) -> None:
        self.by[n].append(piece)
        self.present |= 1 << n

    def _take(self, n: int):
        piece = self.by[n].pop()
        if not self.by[n]:
            self.present &= ~(1 << n)
        return piece

    def longest(self, most: int):
        """(length, piece) of the longest remainder of at most ``most``, else None."""
        under = self.present & ((1 << (most + 1)) - 1)
        return ((n := under.bit_length() - 1), self._take(n)) if under else None

    def shortest(self, over: int):
        """(length, piece) of the shortest remainder longer than ``over``, else None."""
        above = self.present >> (over + 1)
        return ((n := over + 1 + (above & -above).bit_length() - 1), self._take(n)) if above else None

    def total(self) -> int:
        return sum(n * len(x) for n, x in enumerate(self.by) if x)


def pack_block(remainders: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows as (capacity, pieces) and what is carried on; a piece is (document, start, length).

    Every window is full. Without ``last``, pieces that don't fill a window are returned
    to be packed with the next block; with it, they are cut at powers of two.
    """
    shelf = Shelf(tiers[-1])
    for doc, start, n in remainders:
        shelf.put(n, (doc, start))
    windows, rest = [], []
    left = shelf.total()
    for k in range(len(tiers) - 1, -1, -1):
        cap, below = tiers[k], tiers[k - 1] if k else 0
        while left >= cap and shelf.present >> (below + 1):
            pieces, gap = [], cap
            while gap:
                if found := shelf.longest(gap):
                    n, (doc, start) = found
                    pieces.append((doc, start, n))
                    gap -= n
                else:
                    n, (doc, start) = shelf.shortest(gap)
                    pieces.append((doc, start, gap))
                    shelf.put(n - gap, (doc, start + gap))
                    gap = 0
            left -= cap
            windows.append((cap, pieces))
    while found := shelf.longest(tiers[-1]):
        rest.append((*found[1], found[0]))
    if not last:
        return windows, rest
    left = sum(n for _, _, n in rest)
    rest.reverse()
    while left:
        cap = 1 << (min(left, tiers[-1]).bit_length() - 1)
        pieces, gap = [], cap
        while gap:
            doc, start, n = rest.pop()
            pieces.append((doc, start, min(n, gap)))
            if n > gap:
                rest.append((doc, start + gap, n - gap))
            gap -= min(n, gap)
        windows.append((cap, pieces))
        left -= cap
    return windows, []


def per_step(cap: int, step_tokens: int) -> int:
    """Windows of one capacity in a step group."""
    return max(1, step_tokens // cap)


def whole_steps(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> tuple[list, list]:
    """Windows that fill step groups, and the last of each capacity that don't."""
    by_cap: dict[int, list] = {}
    for w in windows:
        by_cap.setdefault(w[0], []).append(w)
    full, rest = [], []
    for cap, own in by_cap.items():
        k = len(own) - len(own) % per_step(cap, step_tokens)
        full += own[:k]
        rest += own[k:]
    return full, rest


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int) -> list[int]:
    """A step group for each window: windows of one capacity, ``step_tokens`` in all (less
    in the last), dealt back and forth in the order of attention cost."""
    out = [0] * len(windows)
    base = 0
    by_cap: dict[int, list[int]] = {}
    for i, (cap, _) in enumerate(windows):
        by_cap.setdefault(cap, []).append(i)
    for cap, own in sorted(by_cap.items()):
        own.sort(key=lambda i: (-sum(n * n for _, _, n in windows[i][1]), i))
        steps, over = divmod(len(own), per_step(cap, step_tokens))
        # The last, short group has windows of all costs too.
        short = {(2 * t + 1) * len(own) // (2 * over) for t in range(over)}
        for j in short:
            out[own[j]] = base + steps
        for j, i in enumerate(i for j, i in enumerate(own) if j not in short):
            lap, at = divmod(j, steps)
            out[i] = base + (at if lap % 2 == 0 else steps - 1 - at)
        base += steps + (over > 0)
    return out


def pack_documents(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pack documents into full windows.

    Returns one row for each piece: ``keys``, then start (ids of the document before the
    piece), length, token_ids (little-endian unsigned 32-bit), doc_tokens (with the end
    id), sequence_id, offset (in the sequence), capacity (the window's size) and step_id.
    Null and empty texts give the end id alone. Rows that repeat are packed each by
    itself. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    tiers = tuple(sorted(tiers))
    source = docs.select(*keys, docs[text].alias("__text"))
    key_fields = [f for f in source.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack_task(batches, list(keys), path, tiers, end_id, step_tokens, TaskContext.get().partitionId())
        release_memory()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    return source.mapInArrow(run, f"{schema}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, capacity int, step_id long")


def _pack_task(batches, keys: list[str], path: str, tiers: tuple[int, ...], end_id: int, step_tokens: int, task: int) -> Iterator[pa.RecordBatch]:
    top = tiers[-1]
    state = {"sequence": task << 32, "step": task << 32}
    held: dict[int, tuple] = {}  # documents with a remainder: keys, tokens, start, bytes
    todo: list[tuple[int, int, int]] = []
    # Windows of the block that aren't dealt to steps yet, and its tokens.
    ready: list[tuple[int, list[tuple[int, int, int]]]] = []
    serial = fresh = 0
    key_types: list = []

    def rows(windows):
        steps = step_groups(windows, step_tokens)
        cols = {k: [] for k in range(len(keys))}
        out = {n: [] for n, _ in _FIELDS}
        for (cap, pieces), step in zip(windows, steps, strict=True):
            at = 0
            for doc, start, n in pieces:
                who, total, base, raw = held[doc]
                for k in range(len(keys)):
                    cols[k].append(who[k])
                for name, v in zip(out, (start, n, raw[4 * (start - base) : 4 * (start - base + n)], total, state["sequence"], at, cap, state["step"] + step), strict=True):
                    out[name].append(v)
                at += n
            state["sequence"] += 1
        state["step"] += max(steps, default=-1) + 1
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in enumerate(key_types)] + [pa.array(out[n], t) for n, t in _FIELDS], names=[*keys, *(n for n, _ in _FIELDS)])

    for batch in batches:
        key_types = [batch.schema.field(k).type for k in keys]
        for part, ids, bounds in encode_column(batch, "__text", path, end_id):
            who = list(zip(*(part.column(part.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            raw = ids.tobytes()
            for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                n, whole = b - a, (b - a) // top * top
                ready += [(top, [(serial, s, top)]) for s in range(0, whole, top)]
                held[serial] = (who[row], n, 0, raw[4 * a : 4 * b])
                if n > whole:
                    todo.append((serial, whole, n - whole))
                fresh += n
                serial += 1
            if len(todo) >= BLOCK_ROWS or fresh >= BLOCK_TOKENS:
                windows, todo = pack_block(todo, tiers, last=False)
                windows, ready = whole_steps(ready + windows, step_tokens)
                if windows:
                    yield rows(windows)
                # Of documents, only what still is to be dealt is kept.
                need: dict[int, int] = {}
                for doc, start, _ in [*todo, *(x for _, pieces in ready for x in pieces)]:
                    need[doc] = min(start, need.get(doc, start))
                held = {d: (w, n, s, data[4 * (s - base) :]) for d, s in need.items() for w, n, base, data in [held[d]]}
                fresh = 0
    if todo or ready:
        windows, _ = pack_block(todo, tiers, last=True)
        yield rows(ready + windows)
