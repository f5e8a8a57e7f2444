"""Fixed atoms of regular expressions over bytes.

An atom is a run of bytes that every match holds, at a bounded distance behind the match's
start.  One automaton finds the atoms of a whole pack in a pass over the data, and an expression
is tried only at the starts that one of its atoms allows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

#: Least bytes of an atom, most starts that one occurrence allows, most atoms of an expression,
#: and most bytes that stand for one place of an atom.
LEAST, STARTS, ATOMS, CHOICES = 2, 1024, 64, 4
#: Widths from here on count as unbounded.
FAR = 1 << 20


@dataclass(frozen=True)
class Atom:
    """``raw`` stands between ``low`` and ``high`` bytes behind the start of a match."""

    raw: bytes
    low: int
    high: int


def _choices(kind, value, fold: bool) -> list[int] | None:
    """The few bytes that a place may hold; None for many."""
    if kind is op.LITERAL:
        found = [value]
    elif kind is op.IN:
        found = []
        for k, v in value:
            if k is op.LITERAL:
                found.append(v)
            elif k is op.RANGE and v[1] - v[0] < CHOICES:
                found += range(v[0], v[1] + 1)
            else:
                return None
    else:
        return None
    if fold:
        found = [x + 32 if 65 <= x <= 90 else x for x in found]
    found = list(dict.fromkeys(found))
    return found if 0 < len(found) <= CHOICES and max(found) < 256 else None


def _width(tree, item) -> tuple[int, int]:
    low, high = parser.SubPattern(tree.state, [item]).getwidth()
    return low, min(high, FAR)


def _rank(found: list[Atom]) -> tuple:
    """Longer atoms first, then a narrower place, then fewer."""
    spread = max(a.high - a.low for a in found)
    return (-min(min(len(a.raw) for a in found), 8) + spread.bit_length() // 2, spread, len(found))


def _best(tree, fold: bool) -> list[Atom] | None:
    """Atoms of which every match holds one; None where there are none."""
    options: list[list[Atom]] = []
    low = high = 0
    run: list[list[int]] = []
    run_low = run_high = 0

    def end_run() -> None:
        # A run with choices is cut so that few atoms stand for it.
        for begin in range(len(run)):
            count, end = 1, begin
            while end < len(run) and count * len(run[end]) <= ATOMS // 4:
                count *= len(run[end])
                end += 1
            if end - begin >= LEAST:
                options.append([Atom(bytes(x), run_low + begin, run_high + begin) for x in product(*run[begin:end])])
            if end == len(run):
                break
        run.clear()

    for item in _flat(tree):
        kind, value = item
        few = _choices(kind, value, fold)
        if few:
            if not run:
                run_low, run_high = low, high
            run.append(few)
            low, high = low + 1, min(high + 1, FAR)
            continue
        end_run()
        inner: list[Atom] | None = None
        if kind is op.SUBPATTERN and not value[1] and not value[2]:
            inner = _best(value[3], fold)
        elif kind is op.BRANCH:
            each = [_best(b, fold) for b in value[1]]
            inner = None if any(x is None for x in each) else [a for x in each for a in x]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _best(value[2], fold)
        elif kind is op.ATOMIC_GROUP:
            inner = _best(value, fold)
        if inner and len(inner) <= ATOMS:
            options.append([Atom(a.raw, low + a.low, min(high + a.high, FAR)) for a in inner])
        a, b = _width(tree, item)
        low, high = low + a, min(high + b, FAR)
    end_run()
    good = [o for o in options if all(a.high < FAR and a.high - a.low < STARTS for a in o)]
    return min(good, key=_rank) if good else None


def _flat(tree):
    """The items in order, plain groups opened, so that runs go on through them."""
    for kind, value in tree:
        if kind is op.SUBPATTERN and not value[1] and not value[2] and not any(k is op.BRANCH for k, _ in value[3]):
            yield from _flat(value[3])
        else:
            yield kind, value


def atoms(pattern: bytes, nocase: bool = False) -> list[Atom] | None:
    """Atoms of an expression, lower-cased where case doesn't count; None where every place of it
    may vary or lies at an unbounded distance behind its start."""
    tree = parser.parse(pattern, re.S | (re.I if nocase else 0))
    return _best(tree, bool(tree.state.flags & re.I))


def folds(pattern: bytes, nocase: bool = False) -> bool:
    """Whether case doesn't count, by ``nocase`` or by a flag in the expression."""
    return bool(parser.parse(pattern, re.S | (re.I if nocase else 0)).state.flags & re.I)
