"""The signature scan: every hit of a rule pack's strings, and the rules' conditions.

Offsets are in bytes.  Patterns are compiled once per Python worker; the corpus is scanned
where it is read, and only hits are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .atoms import STARTS, atoms, folds, parser
from .atoms import op as kinds

KEYS = ("scan_id", "hostname", "path")
#: Hits that a task holds as Python objects before it gives them on.
HELD = 1 << 14


@dataclass(frozen=True)
class Pattern:
    """One string of a rule: kind literal, regex or hex; wide is UTF-16LE."""

    rule: str
    id: str | None
    pattern: str
    kind: str = "literal"
    nocase: bool = False
    wide: bool = False
    ascii: bool = True


@dataclass(frozen=True)
class Rule:
    """A rule with its condition as Spark SQL over ``n`` and ``first`` (maps from string id
    to the number of hits and the first offset), filepath, filename and file_size."""

    rule: str
    strings: tuple[Pattern, ...]
    condition: str
    severity: str = "low"
    tags: tuple[str, ...] = ()
    meta: tuple[tuple[str, str], ...] = ()


def of_them(ids: list[str], least: int = 1) -> str:
    """The condition that ``least`` of the strings have hits."""
    return f"({' + '.join(f"int(coalesce(n['{i}'], 0) > 0)" for i in ids)}) >= {least}"


def at_offset(string_id: str, offset: int) -> str:
    """The condition that a string is found first at an offset (0: at the file's start)."""
    return f"coalesce(first['{string_id}'], -1) = {offset}"


def rules_of(ruleset: DataFrame) -> list[Rule]:
    """The valid rules of a loaded pack, whose size the loader has bounded."""
    out = []
    valid = ruleset.where("status = 'valid'") if "status" in ruleset.columns else ruleset
    for r in valid.orderBy("rule").collect():
        meta = r["meta"] or {}
        strings = tuple(Pattern(r["rule"], s["id"], s["pattern"], s["kind"] or "literal", bool(s["nocase"]), bool(s["wide"]), True if s["ascii"] is None else s["ascii"] or not s["wide"]) for s in r["strings"] or [])
        out.append(Rule(r["rule"], strings, r["condition"], meta.get("severity", "low"), tuple(r["tags"] or ()), tuple(sorted(meta.items()))))
    return out


def hex_regex(text: str) -> bytes:
    """A byte pattern ``4D 5A ?? [2-4] ( 01 | 02 )`` as a regular expression."""
    out = []
    for t in re.findall(r"[0-9A-Fa-f?]{2}|\[\d*-?\d*\]|[()|]", text):
        if t[0] == "[":
            low, dash, high = t[1:-1].partition("-")
            out.append(f".{{{low or 0},{high}}}?".encode() if dash else f".{{{low}}}".encode())
        elif t in "()|":
            out.append({"(": b"(?:", ")": b")", "|": b"|"}[t])
        elif t == "??":
            out.append(b".")
        elif "?" in t:
            digits = [f"{a}{b}" for a in ("0123456789abcdef" if t[0] == "?" else t[0]) for b in ("0123456789abcdef" if t[1] == "?" else t[1])]
            out.append(b"[" + b"".join(re.escape(bytes.fromhex(d)) for d in digits) + b"]")
        else:
            out.append(re.escape(bytes.fromhex(t)))
    return b"".join(out)


_CLASSES = {kinds.CATEGORY_DIGIT: rb"\d", kinds.CATEGORY_NOT_DIGIT: rb"\D", kinds.CATEGORY_WORD: rb"\w", kinds.CATEGORY_NOT_WORD: rb"\W", kinds.CATEGORY_SPACE: rb"\s", kinds.CATEGORY_NOT_SPACE: rb"\S"}
_PLACES = {kinds.AT_BEGINNING: b"^", kinds.AT_END: b"$", kinds.AT_BEGINNING_STRING: rb"\A", kinds.AT_END_STRING: rb"\Z"}
_REPEATS = {kinds.MAX_REPEAT: b"", kinds.MIN_REPEAT: b"?", kinds.POSSESSIVE_REPEAT: b"+"}


def _one(value: int) -> bytes:
    return b"\\x%02x" % value


def wide_regex(pattern: bytes) -> bytes:
    """A regular expression over UTF-16LE: each place that takes a byte takes a zero byte after
    it. Look-around, references and word boundaries have no such form and raise."""

    def several(items) -> bytes:
        return b"".join(map(wide, items))

    def wide(item) -> bytes:
        kind, value = item
        if kind is kinds.LITERAL:
            return _one(value) + rb"\x00"
        if kind is kinds.NOT_LITERAL:
            return b"[^" + _one(value) + rb"]\x00"
        if kind is kinds.ANY:
            return rb".\x00"
        if kind is kinds.IN:
            out = b""
            for k, v in value:
                out += b"^" if k is kinds.NEGATE else _one(v) if k is kinds.LITERAL else _one(v[0]) + b"-" + _one(v[1]) if k is kinds.RANGE else _CLASSES[v]
            return b"[" + out + rb"]\x00"
        if kind is kinds.BRANCH:
            return b"(?:" + b"|".join(map(several, value[1])) + b")"
        if kind is kinds.SUBPATTERN and not value[1] and not value[2]:
            return b"(?:" + several(value[3]) + b")"
        if kind in _REPEATS:
            most = b"" if value[1] is kinds.MAXREPEAT else b"%d" % value[1]
            return b"(?:" + several(value[2]) + b"){%d,%s}" % (value[0], most) + _REPEATS[kind]
        if kind is kinds.AT and value in _PLACES:
            return _PLACES[value]
        raise ValueError(f"no wide form of {kind} in {pattern!r}")

    tree = parser.parse(pattern, re.S)
    return (b"(?i)" if tree.state.flags & re.I else b"") + several(tree)


class Matcher:
    """Compiled forms of all patterns: an Aho-Corasick automaton for what is found as it is and
    one for what is found without case, so that a pack of thousands takes one pass over
    the bytes.

    They hold the literals and an atom of each regular expression and byte pattern, which is
    then tried around the atom alone. The few expressions without an atom (such as
    ``[0-9]+``) are searched one by one.
    """

    def __init__(self, patterns: tuple[Pattern, ...]):
        self.regex: list[tuple[Pattern, re.Pattern, int]] = []
        self.alone: list[tuple[Pattern, re.Pattern]] = []
        words: dict[bool, dict[bytes, tuple[list, list]]] = {False: {}, True: {}}
        forms = Counter((p.rule, p.id) for p in patterns for _ in self._forms(p))
        for p in patterns:
            for form in self._forms(p):
                if p.kind == "literal":
                    words[p.nocase].setdefault(form.lower() if p.nocase else form, ([], []))[0].append(p)
                    continue
                compiled, found = re.compile(form, re.S | (re.I if p.nocase else 0)), atoms(form, p.nocase)
                if not found:
                    self.alone.append((p, compiled))
                    continue
                own = words[folds(form, p.nocase)]
                for a in found:
                    own.setdefault(a.raw, ([], []))[1].append((len(self.regex), a.low, a.high))
                self.regex.append((p, compiled, max(a.high for a in found)))
        #: Strings whose hits may come out of order.
        self.mixed = {k for k, n in forms.items() if n > 1} | {(p.rule, p.id) for p, _, _ in self.regex}
        #: An atom that ends later may begin so much earlier.
        self.longest = max((len(w) for own in words.values() for w in own), default=0)
        self.exact, self.folded = (self._automaton(words[k]) for k in (False, True))

    @staticmethod
    def _forms(p: Pattern) -> list[bytes]:
        """The bytes or expressions that a pattern stands for."""
        if p.kind == "hex":
            return [hex_regex(p.pattern)]
        raw = p.pattern.encode()
        plain = [raw] if p.ascii or not p.wide else []
        if p.wide:
            plain.append(p.pattern.encode("utf-16-le") if p.kind == "literal" else wide_regex(raw))
        return plain

    @staticmethod
    def _automaton(words: dict[bytes, tuple[list, list]]):
        """Over bytes as Latin-1 characters; None without words."""
        made = ahocorasick.Automaton()
        for raw, (owners, tries) in words.items():
            if raw:
                made.add_word(raw.decode("latin-1"), (len(raw), tuple(owners), tuple(tries)))
        if not len(made):
            return None
        made.make_automaton()
        return made

    def hits(self, data: bytes) -> Iterator[tuple[Pattern, int, bytes]]:
        """Every start offset of every string, overlaps included."""
        tried: dict[int, set[int]] = {}
        for automaton, fold in ((self.exact, False), (self.folded, True)):
            if automaton is not None:
                for end, (size, owners, tries) in automaton.iter((data.lower() if fold else data).decode("latin-1")):
                    at = end + 1 - size
                    for p in owners:
                        yield p, at, data[at : end + 1]
                    for i, low, high in tries:
                        (p, rx, reach), seen = self.regex[i], tried.setdefault(i, set())
                        if len(seen) > 4 * (STARTS + reach):  # no later atom allows those further back
                            tried[i] = seen = {s for s in seen if s + reach >= at - self.longest}
                        for start in range(max(at - high, 0), at - low + 1):
                            if start not in seen:
                                seen.add(start)
                                m = rx.match(data, start)
                                if m and m.end() > start:
                                    yield p, start, m.group()
        for p, rx in self.alone:
            m = rx.search(data)
            while m and m.start() < len(data):  # at the end there is only the empty match
                if m.end() > m.start():
                    yield p, m.start(), m.group()
                m = rx.search(data, m.start() + 1)

    def apart(self, data: bytes) -> Iterator[tuple[Pattern, int, bytes]]:
        """Of those the ones that a search finds which goes on behind the last one of its string.

        Literals and expressions without an atom come in order; only hits of the others, and of
        strings of several forms, are held until the file is through.
        """
        held, ends = [], {}

        def kept(p: Pattern, at: int, raw: bytes) -> bool:
            if at < ends.get((p.rule, p.id), 0):
                return False
            ends[p.rule, p.id] = at + len(raw)
            return True

        for hit in self.hits(data):
            if (hit[0].rule, hit[0].id) in self.mixed:
                held.append(hit)
            elif kept(*hit):
                yield hit
        held.sort(key=lambda hit: hit[1])
        yield from (hit for hit in held if kept(*hit))


class Gathered:
    """One rule's hits in one file: counts and first offsets by string, and the first
    ``cap`` hits in order (0: all), of which no more than a few times as many are held."""

    def __init__(self, cap: int):
        self.cap, self.count, self.first, self.hits = cap, Counter(), {}, []

    def add(self, string_id: str, offset: int, raw: bytes) -> None:
        self.count[string_id] += 1
        self.first[string_id] = min(offset, self.first.get(string_id, offset))
        self.hits.append((offset, string_id, raw))
        if self.cap and len(self.hits) > 8 * self.cap + 1000:
            self._cut()

    def _cut(self) -> None:
        self.hits = sorted((o, i, render(r) if isinstance(r, bytes) else r) for o, i, r in self.hits)
        if self.cap:
            del self.hits[self.cap :]

    def row(self) -> tuple[int, list[dict], list[dict]]:
        self._cut()
        ids = [{"id": i, "count": self.count[i], "first": self.first[i]} for i in sorted(self.count)]
        return sum(self.count.values()), ids, [{"i": k, "offset": o, "string_id": i, "matched": m} for k, (o, i, m) in enumerate(self.hits, 1)]


def render(raw: bytes) -> str:
    """Matched bytes as text: UTF-16LE where every second byte is 0, else UTF-8 if it is
    printable (tabs too), else hex."""
    if len(raw) >= 2 and len(raw) % 2 == 0 and not any(raw[1::2]):
        return raw.decode("utf-16-le", "replace")
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return raw.hex()
    return text if all(c.isprintable() or c == "\t" for c in text) else raw.hex()


_MATCHERS: dict[tuple[Pattern, ...], Matcher] = {}


def _matcher(patterns: tuple[Pattern, ...]) -> Matcher:
    if patterns not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[patterns] = Matcher(patterns)
    return _MATCHERS[patterns]


def scan_hits(corpus: DataFrame, rules: list[Rule], carry: tuple[str, ...] = (), apart: bool = False) -> DataFrame:
    """(scan_id, hostname, path, rule, string_id, offset, matched) of every hit.

    The corpus has scan_id, hostname, path and content (bytes or text; null has no hits).
    ``carry`` names columns that come along. With ``apart``, a hit inside an earlier one of its string
    is left out, as by a search that goes on behind each hit.
    """
    ship(corpus.sparkSession)
    patterns = tuple(p for r in rules for p in r.strings)
    names = [*KEYS, *carry]
    source = corpus.select(*names, F.col("content").cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(patterns)

        def made(b: pa.RecordBatch, at: list, out: list) -> pa.RecordBatch:
            keys = b.select(list(range(len(names)))).take(pa.array(at, pa.int64()))
            types = [pa.string(), pa.string(), pa.int64(), pa.string()]
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*names, "rule", "string_id", "offset", "matched"])

        for b in batches:
            at, out = [], []
            for row, cell in enumerate(b.column(len(names))):
                for p, offset, raw in (matcher.apart if apart else matcher.hits)(cell.as_py() or b""):
                    at.append(row)
                    out.append((p.rule, p.id or "$?", offset, render(raw)))
                    if len(out) >= HELD:
                        yield made(b, at, out)
                        at, out = [], []
            if out:
                yield made(b, at, out)
            pa.default_memory_pool().release_unused()

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "content")
    return source.mapInArrow(run, f"{head}, rule string, string_id string, offset bigint, matched string")


_ID = pa.struct([("id", pa.string()), ("count", pa.int64()), ("first", pa.int64())])
_HIT = pa.struct([("i", pa.int32()), ("offset", pa.int64()), ("string_id", pa.string()), ("matched", pa.string())])
_ABOUT = (("tags", pa.list_(pa.string())), ("meta", pa.map_(pa.string(), pa.string())))
FOUND = (("file_size", pa.int64()), ("file_sha256", pa.string()), ("rule", pa.string()), ("match_scope", pa.string()), ("match_count", pa.int64()), ("ids", pa.list_(_ID)), ("sample_rows", pa.list_(_HIT)), ("severity", pa.string()), ("__case", pa.int32()))


#: What a condition may say of a file, and words that make something else of null.
_VARIABLES = re.compile(r"\b(?:filepath|filename|file_size|filepath_lower|filename_lower|path)\b", re.I)
_HITS = re.compile(r"coalesce\s*\(\s*(?:n|first)\['[^']*'\]\s*,\s*-?\d+\s*\)", re.I)
_OPS = re.compile(r"[()+\-*/<>=!,.%\s\d]|\b(?:and|or|not|int|like|ilike|rlike|contains|startswith|endswith|lower|upper|length)\b|'(?:[^'\\]|\\.|'')*'", re.I)


def may_hold_without_hits(spark: SparkSession, rules: tuple[Rule, ...]) -> list[Rule]:
    """The rules with strings whose condition may hold on a file in which none is found, such as
    ``NOT (n['$a'] > 0)`` or one of the file's name alone.

    Each is evaluated once, without hits and with the file unknown. What is false then is false
    for every file, if it consists of operators for which null is unknown.
    """
    if rules not in _WITHOUT:
        empty = "CAST(map() AS MAP<STRING, BIGINT>)"
        file = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in ("filepath", "filename", "filepath_lower", "filename_lower", "path"))
        one = spark.sql(f"SELECT {empty} AS n, {empty} AS first, {file}, CAST(NULL AS BIGINT) AS file_size")
        got = one.selectExpr(*(f"({r.condition}) AS c{i}" for i, r in enumerate(rules))).first() if rules else ()
        out = []
        for r, holds_ in zip(rules, got, strict=True):
            rest = _OPS.sub("", _VARIABLES.sub("", _HITS.sub("", r.condition)))
            known = not _VARIABLES.search(r.condition)
            if holds_ or (not known and (holds_ is None or rest)):
                out.append(r)
        _WITHOUT.clear()
        _WITHOUT[rules] = out
    return _WITHOUT[rules]


_WITHOUT: dict[tuple[Rule, ...], list[Rule]] = {}


def scan_files(corpus: DataFrame, rules: list[Rule], sample_cap: int = 50, carry: tuple[str, ...] = (), about: bool = False) -> DataFrame:
    """A row for each file and rule that fires on it, in one pass over the contents.

    Columns: scan_id, hostname, path, ``carry``, file_size (-1: no content), file_sha256,
    rule, match_scope (string, or rule where it holds without a string found), match_count, ids
    (id, count and first offset of each string with hits), sample_rows (the first
    ``sample_cap`` hits in order, 0: all), severity and, with ``about``, tags and meta of the rule.
    The corpus has a row for each file.

    A file's hits all arise in the task that reads it, so they are counted there and never
    shuffled, and files that match are hashed there. Conditions are evaluated on those rows, each
    by its number; those that may hold without hits before the file is passed to Python, for
    files that turn out to have none.
    """
    ship(corpus.sparkSession)
    with_strings, without = [r for r in rules if r.strings], [r for r in rules if not r.strings]
    without += may_hold_without_hits(corpus.sparkSession, tuple(with_strings))
    patterns = tuple(p for r in with_strings for p in r.strings)
    conditions = list(dict.fromkeys(r.condition for r in with_strings))
    case = {c: i for i, c in enumerate(conditions)}
    known = {r.rule: (r.severity, case.get(r.condition, -1), list(r.tags), list(r.meta)) for r in rules}
    names = [*KEYS, *carry]
    body = F.col("content").cast("binary")
    none = [F.expr("CAST(map() AS MAP<STRING, BIGINT>)").alias(c) for c in ("n", "first")]
    files = corpus.select(*names, body.alias("content"), F.coalesce(F.octet_length(body).cast("bigint"), F.lit(-1)).alias("file_size"), *file_variables(), *none)
    alone = F.filter(F.array(*(F.when(F.expr(r.condition), F.lit(r.rule)) for r in without)).cast("array<string>"), lambda x: x.isNotNull())
    source = files.select(*names, "content", alone.alias("alone"))
    fields = FOUND + (_ABOUT if about else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(patterns)

        def made(b: pa.RecordBatch, at: list, out: list) -> pa.RecordBatch:
            keys = b.select(list(range(len(names)))).take(pa.array(at, pa.int64()))
            cols = list(zip(*out, strict=True)) or [()] * len(fields)
            return pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], names=[*names, *(n for n, _ in fields)])

        for b in batches:
            at, out, held = [], [], 0
            for row, (cell, fired) in enumerate(zip(b.column(len(names)), b.column(len(names) + 1), strict=True)):
                data, by_rule = cell.as_py(), {}
                for p, offset, raw in matcher.hits(data or b""):
                    by_rule.setdefault(p.rule, Gathered(sample_cap)).add(p.id or "$?", offset, raw)
                rows = [(r, "string", *g.row()) for r, g in by_rule.items()] + [(r, "rule", 1, [], []) for r in fired.as_py() if r not in by_rule]
                if rows:
                    who = (-1, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                    at += [row] * len(rows)
                    out += [(*who, *r, *known[r[0]][: 4 if about else 2]) for r in rows]
                    held += sum(1 + len(r[-1]) for r in rows)
                if held >= HELD:
                    yield made(b, at, out)
                    at, out, held = [], [], 0
            if out:
                yield made(b, at, out)
            pa.default_memory_pool().release_unused()

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name not in ("content", "alone"))
    schema = head + ", file_size bigint, file_sha256 string, rule string, match_scope string, match_count bigint, ids array<struct<id:string,count:bigint,first:bigint>>, sample_rows array<struct<i:int,offset:bigint,string_id:string,matched:string>>, severity string, __case int"
    found = source.mapInArrow(run, schema + (", tags array<string>, meta map<string,string>" if about else ""))
    maps = found.withColumns({"n": F.map_from_entries(F.transform("ids", lambda s: F.struct(s["id"], s["count"]))), "first": F.map_from_entries(F.transform("ids", lambda s: F.struct(s["id"], s["first"])))})
    decided = maps.select("*", *file_variables()).where((F.col("match_scope") == "rule") | numbered(conditions, "__case"))
    return decided.select(*names, *(n for n, _ in fields if n != "__case"))


def numbered(conditions: list[str], number: str, chunk: int = 32) -> Column:
    """Whether the condition of a number holds: chunks of numbers, then the one among them."""
    out = F.when(F.lit(False), F.lit(False))
    for i in range(0, len(conditions), chunk):
        inner = F.when(F.lit(False), F.lit(False))
        for k, c in enumerate(conditions[i : i + chunk], i):
            inner = inner.when(F.col(number) == k, F.expr(c))
        out = out.when(F.col(number).between(i, i + chunk - 1), inner)
    return F.coalesce(out, F.lit(False))


def holds(rules: list[Rule], chunk: int = 100) -> Column:
    """Whether the row's rule's condition holds: one column however many rules there are, by
    chunks of cases, each null for other chunks' rules."""
    cases = []
    for i in range(0, len(rules), chunk):
        own = rules[i : i + chunk]
        case = F.when(F.col("rule") == own[0].rule, F.coalesce(F.expr(own[0].condition), F.lit(False)))
        for r in own[1:]:
            case = case.when(F.col("rule") == r.rule, F.coalesce(F.expr(r.condition), F.lit(False)))
        cases.append(case)
    return F.coalesce(*cases, F.lit(False))


def decide(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows for which their rule's condition holds."""
    return rows.where(holds(rules))


def file_variables(path: str = "path") -> list[Column]:
    """The external variables of conditions."""
    name = F.element_at(F.split(F.translate(F.col(path), "\\", "/"), "/"), -1)
    return [F.col(path).alias("filepath"), name.alias("filename"), F.lower(F.col(path)).alias("filepath_lower"), F.lower(name).alias("filename_lower")]


def eval_conditions(hits: DataFrame, rules: list[Rule], corpus: DataFrame | None = None) -> DataFrame:
    """(scan_id, hostname, path, rule, match_scope): rules that fire on a file.

    The plain form, step by step, which :func:`scan_files` replaces: hits are shuffled and
    contents read again. Rules with strings are decided on their hits; those that hold without any,
    and rules without strings, on the corpus, with match_scope "rule".
    """
    with_strings, without = [r for r in rules if r.strings], [r for r in rules if not r.strings]
    out = None
    if with_strings:
        each = hits.groupBy(*KEYS, "rule", "string_id").agg(F.count("*").alias("c"), F.min("offset").alias("f"))
        maps = each.groupBy(*KEYS, "rule").agg(F.map_from_entries(F.collect_list(F.struct("string_id", "c"))).alias("n"), F.map_from_entries(F.collect_list(F.struct("string_id", "f"))).alias("first"))
        out = decide(maps.select("*", *file_variables()), with_strings).select(*KEYS, "rule", F.lit("string").alias("match_scope"))
    if corpus is not None:
        without = without + may_hold_without_hits(corpus.sparkSession, tuple(with_strings))
    if without and corpus is not None:
        names = F.explode(F.array(*(F.lit(r.rule) for r in without))).alias("rule")
        size = [F.octet_length(F.col("content").cast("binary")).alias("file_size")] if "file_size" not in corpus.columns else ["file_size"]
        files = corpus.select(*KEYS, *size, *file_variables()).select("*", names, F.expr("CAST(map() AS MAP<STRING, BIGINT>)").alias("n"), F.expr("CAST(map() AS MAP<STRING, BIGINT>)").alias("first"))
        alone = decide(files, without).select(*KEYS, "rule", F.lit("rule").alias("match_scope")).join(hits.select(*KEYS, "rule"), [*KEYS, "rule"], "left_anti")
        out = alone if out is None else out.unionByName(alone)
    if out is None:
        return hits.select(*KEYS, "rule", F.lit("string").alias("match_scope")).limit(0)
    return out
