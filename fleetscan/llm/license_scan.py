"""Licence scan by conditional compression (operator 10).

A licence word makes the words around it a candidate block, over line breaks, comment signs
and blank lines.  In a block, every word that a template's meaningful words begin with opens a
candidate window: the words up to where the template would end.  The window is compressed with
and without the template as a raw Zstandard dictionary.  A template that saves less of it than
``SHARE`` of what it saves of its own text is dropped there; the others are ranked by the bytes
saved, and in that order confirmed by their exact wording: the template's meaningful words (all
but filler) stand one after the other with nothing but filler between, and at most a share
of its filler is missing.  A licence of another name or version is another licence, however well
it compresses.  Of notices that overlap the one that saves most is kept.  SPDX tags are read by
their own grammar.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import ship

#: Short notices of public licences (id, text), public wordings.
_NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
)
_GNU = (("GPL-2.0", "", "General", "2"), ("GPL-3.0", "", "General", "3"), ("LGPL-2.0", "L", "Library General", "2"), ("LGPL-2.0", "L", "Lesser General", "2"), ("LGPL-2.1", "L", "Lesser General", "2.1"), ("LGPL-3.0", "L", "Lesser General", "3"), ("AGPL-3.0", "A", "Affero General", "3"))
_GNU_FORMS = (
    "under the terms of the GNU {n} Public License as published by the Free Software Foundation, either version {v} of the License",
    "under the terms of the GNU {n} Public License as published by the Free Software Foundation; version {v} of the License",
    "under the terms of version {v} of the GNU {n} Public License as published by the Free Software Foundation",
    "under the terms of the GNU {n} Public License version {v} as published by the Free Software Foundation",
    "GNU {n} Public License, version {v}",
    "GNU {n} Public License ({a}GPL), version {v}",
    "GNU {n} Public License v{v}",
    "version {v} of the GNU {n} Public License",
    "{a}GPL {v}",
    "{a}GPLv{v}",
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
#: How the full BSD texts go on; the third clause names an owner, so it isn't read on.
_BSD_ENDS = (("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY"), ("BSD-3-Clause", "{2} Neither the name of"), ("BSD-3-Clause", "{2} The name of"), ("BSD-3-Clause", "{2} The names of"), ("BSD-4-Clause", "{2} All advertising materials mentioning features or use of this software must display the following acknowledgement:"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
#: All templates; beside the short notices the public standard notices and
#: short forms of each licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    *_NOTICES,
    *((name, form.format(a=a, n=n, v=v)) for name, a, n, v in _GNU for form in _GNU_FORMS),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT"),
    ("MIT", "MIT-licensed"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache Software License, Version 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("Apache-2.0", "Licensed under Apache-2.0"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "MPL 2.0"),
    ("MPL-2.0", "MPLv2"),
    *((name, (_BSD + end).format(*marks)) for name, end in _BSD_ENDS for marks in (("1.", "2.", "3."), ("a", "b", "c"), ("", "", ""))),
    *((f"BSD-{n}-Clause", form) for n, word in ((2, "two"), (3, "three"), (4, "four")) for form in (f"BSD {n}-Clause License", f"{n}-Clause BSD License", f"{word}-clause BSD License", f"BSD {word}-clause License", f"BSD-{n}-Clause")),
    ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-3-Clause", "New BSD License"),
    ("BSD-3-Clause", "Modified BSD License"),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "released under the Unlicense"),
    ("Unlicense", "The Unlicense license"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal"),
    *((f"CC-{short}-4.0", form) for short, long in _CC for form in (f"CC {short} 4.0", f"CC-{short} 4.0", f"CC-{short}-4.0", f"Creative Commons {long} 4.0 International License", f"Creative Commons {long} 4.0")),
)
#: Words that may differ between a notice and its template.
FILLER = frozenset("a an and are as available code document distributed file files in is it license licensed of or permitted project published released software terms the this to under v version with work works".split())
CANDIDATE = re.compile(r"licen[sc]|copyright|all\W+rights\W+reserved|public\W+domain|hereby\W+granted|redistribution\W+and\W+use|\bCC[ -]?(?:BY|0)\b|\b(?:[AL]?GPL|MPL|BSD[ -](?:\d|two|three)|creative\W+commons)", re.I)
_TOKEN = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)*|\d+(?:\.\d+)*")
#: Words of comment signs, which aren't of the text.
_COMMENT = re.compile(r"^[ \t]*(?:REM|dnl)\b", re.M)
#: Words of the template that a notice may lack (share).
MAX_MISSING = 0.25
#: Compression level: templates are ranked by what a block's bytes have in common with them.
LEVEL = 3
#: Share of what a template saves of its own text, less some bytes by which short texts vary, below
#: which it is dropped. On the given texts and on templates with filler put in and left out, none
#: is lost (see the tests).
SHARE, SLACK = 0.15, 6
#: The end of a sentence: no version number of a name before it stands behind it.
_STOP = re.compile(r"(?<!\bv)(?<!\bver)\.\s", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)|\blicen[sc]e[\x22']?\s*[:=]\s*[\x22']([^\x22'\r\n]+)[\x22']", re.I)
_SPDX_ID = re.compile(r"[\s(]*([A-Za-z0-9][\w.+-]*)(?:\s+WITH\s+[\w.+-]+)?[\s)]*?(?:\)*\s+(AND|OR)\s+|(?=[\s)]|$))", re.I)


def plain(word: str) -> str:
    """A word as it is compared: lower case, one spelling, 3 for 3.0."""
    if word[0].isdigit():
        return re.sub(r"(?:\.0)+$", "", word)
    return word.lower().replace("licence", "license")


def tokens(text: str) -> list[str]:
    return [plain(m) for m in _TOKEN.findall(text)]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, as early in ``b`` as may be."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class Scanner:
    """Templates with their dictionaries; one is made for each worker."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.each, self.opens = [], {}
        self.ids = {n.lower(): n for n, _ in templates}
        for i, (name, t) in enumerate(templates):
            want = tokens(t)
            core = [k for k, w in enumerate(want) if w not in FILLER] or list(range(len(want)))
            shared = zstandard.ZstdCompressionDict(" ".join(want).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.opens.setdefault(want[core[0]], []).append(i)
            self.each.append((name, want, core, zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)))
        # Words beside a licence word that a notice may reach: a template's, and added filler.
        self.reach = 3 * max((len(want) for _, want, _, _ in self.each), default=0) // 2

        self.windows: dict[tuple[str, int], int] = {}
        self.least = [SHARE * self.saved(want, i) - SLACK for i, (_, want, _, _) in enumerate(self.each)]

    def saved(self, words: list[str], i: int) -> int:
        """Bytes that template ``i`` saves of words. Windows that come again are kept."""
        window = " ".join(words)
        if (window, i) not in self.windows:
            if len(self.windows) > 20_000:
                self.windows.clear()
            raw = window.encode()
            if (window, -1) not in self.windows:
                self.windows[window, -1] = len(self.alone.compress(raw))
            self.windows[window, i] = self.windows[window, -1] - len(self.each[i][3].compress(raw))
        return self.windows[window, i]

    def match(self, i: int, own: list[str], heavy: list[int], at: int, text: str, spans: list[tuple[int, int]]) -> tuple[int, int, list[str], list[str]] | None:
        """(first word, end, words missing, words added) of template ``i`` where its first
        meaningful word is the text's ``heavy[at]``; None unless it is confirmed there."""
        _, want, core, _ = self.each[i]
        places = heavy[at : at + len(core)]
        if len(places) < len(core) or any(own[p] != want[k] for p, k in zip(places, core, strict=True)):
            return None
        if len(core) <= 4 and any(own[q][0].isdigit() and _STOP.search(text, spans[p][1], spans[q][0]) for p, q in zip(places, places[1:], strict=False)):
            return None
        held, taken = set(core), set(places)
        for k, x, p, q in zip(core, core[1:], places, places[1:], strict=False):
            for i_, j in common(want[k + 1 : x], own[p + 1 : min(q, p + 1 + self.reach)]):
                held.add(k + 1 + i_)
                taken.add(p + 1 + j)
        low = max(heavy[at - 1] + 1 if at else 0, places[0] - self.reach)
        for i_, j in common(want[: core[0]][::-1], own[low : places[0]][::-1]):
            held.add(core[0] - 1 - i_)
            taken.add(places[0] - 1 - j)
        high = min(heavy[at + len(core)] if at + len(core) < len(heavy) else len(own), places[-1] + 1 + self.reach)
        for i_, j in common(want[core[-1] + 1 :], own[places[-1] + 1 : high]):
            held.add(core[-1] + 1 + i_)
            taken.add(places[-1] + 1 + j)
        missing = [w for k, w in enumerate(want) if k not in held]
        if len(missing) > MAX_MISSING * len(want):
            return None
        a, b = min(taken), max(taken) + 1
        # 'MIT License' alone is read as a name only: 'mit' is a word too.
        if len(want) <= 2 and len(core) == 1 and (not text[spans[places[0]][0] : spans[places[0]][0] + 3].isupper() or re.search(r"[.!?]\s|\n\s*\n", text[spans[a][0] : spans[b - 1][1]])):
            return None
        return a, b, missing, [own[j] for j in range(a, b) if j not in taken]

    def tagged(self, text: str) -> list[tuple[str, int, int]]:
        """(licence, start, end) of the ids of SPDX tags, and of fields named license whose
        value is an id of the templates."""
        out = []
        for m in _SPDX.finditer(text):
            g = 1 if m[1] is not None else 2
            at, end = m.span(g)
            while x := _SPDX_ID.match(text, at, end):
                base = re.sub(r"-only$|-or-later$|\+$", "", x[1], flags=re.I)
                known = self.ids.get(base.lower())
                if known or (g == 1 and x[1].upper() not in ("NONE", "NOASSERTION")):
                    out.append((known or x[1], *x.span(1)))
                at = x.end()
                if not x[2]:
                    break
        return out

    def blocks(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges of words around the licence words of a text, apart from each other."""
        starts, out = [a for a, _ in spans], []
        for m in CANDIDATE.finditer(text):
            at = bisect.bisect_right(starts, m.start()) - 1
            low, high = max(0, at - self.reach), min(len(spans), bisect.bisect_left(starts, m.end()) + self.reach)
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], high)
            else:
                out.append((low, high))
        return out

    def window(self, i: int, own: list[str], heavy: list[int], at: int) -> list[str]:
        """The words that template ``i`` may have where its first meaningful word is
        ``heavy[at]``: up to its last one, and as many before and after as it has itself."""
        _, want, core, _ = self.each[i]
        last = heavy[min(at + len(core), len(heavy)) - 1]
        return own[max(0, heavy[at] - core[0]) : last + len(want) - core[-1]]

    def ranked(self, own: list[str], heavy: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
        """(bytes saved, template, place of its first word) of a block's candidate windows, most
        saved first; of equal ones those with more meaningful words, and more words."""
        out = []
        for at in range(low, high):
            for i in self.opens.get(own[heavy[at]], ()):
                saved = self.saved(self.window(i, own, heavy, at), i)
                if saved >= self.least[i]:
                    out.append((saved, i, at))
        return sorted(out, key=lambda x: (-x[0], -len(self.each[x[1]][2]), -len(self.each[x[1]][1]), x[1], x[2]))

    def notices(self, text: str) -> list[dict]:
        """Every confirmed notice that no better one overlaps, in the order of the text."""
        off = {m.end() for m in _COMMENT.finditer(text)}
        found = [m for m in _TOKEN.finditer(text) if m.end() not in off]
        own, spans = [plain(m[0]) for m in found], [m.span() for m in found]
        heavy = [j for j, w in enumerate(own) if w not in FILLER]
        starts, out = [], []

        def take(name: str, start: int, end: int, saved: int, missing: list[str], added: list[str]) -> None:
            k = bisect.bisect(starts, start)
            if (k == 0 or out[k - 1]["end"] <= start) and (k == len(out) or end <= starts[k]):
                starts.insert(k, start)
                out.insert(k, {"license": name, "start": start, "end": end, "saved": saved, "missing": missing, "added": added})

        # An id in a tag is as good as can be.
        for n, a, b in self.tagged(text):
            take(n, a, b, max([0, *(self.saved(tokens(text[a:b]), i) for i, t in enumerate(self.each) if t[0] == n)]), [], [])
        for low, high in self.blocks(text, spans):
            for saved, i, at in self.ranked(own, heavy, bisect.bisect_left(heavy, low), bisect.bisect_left(heavy, high)):
                if m := self.match(i, own, heavy, at, text, spans):
                    a, b, missing, added = m
                    take(self.each[i][0], spans[a][0], spans[b - 1][1], saved, missing, added)
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def scan_text(text: str | None, scanner: Scanner) -> tuple[int, list[dict]]:
    """Lines with a licence word, and the confirmed notices of one text."""
    lines, at = 0, -1
    for m in CANDIDATE.finditer(text or ""):
        if at < 0 or text.find("\n", at, m.start()) >= 0:
            lines += 1
        at = m.start()
    return lines, scanner.notices(text) if lines else []


NOTICE = "array<struct<license:string,start:bigint,end:bigint,saved:bigint,missing:array<string>,added:array<string>>>"


def scan_licenses(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``keys``, n_candidates (lines with a licence word) and notices (licence, its offsets,
    bytes saved, words missing and added) of every row; null and empty texts have none. Repeated rows give
    equal results; texts of any length are scanned whole, in time that grows with their
    length; other columns are ignored."""
    ship(docs.sparkSession)
    source = docs.select(*keys, docs[text].alias("__text"))
    item = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.int64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if templates not in _SCANNERS:
            _SCANNERS[templates] = Scanner(templates)
        for b in batches:
            got = [scan_text(t.as_py(), _SCANNERS[templates]) for t in b.column(b.schema.get_field_index("__text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array([n for n, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(item))], names=[*keys, "n_candidates", "notices"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    return source.mapInArrow(run, f"{schema}, n_candidates long, notices {NOTICE}")
