import random
import re
import time

import pytest

from fleetscan.operators import findings as fo
from fleetscan.operators.alerts import cap_alerts
from fleetscan.operators.scan import Matcher, Pattern, Rule, at_offset, eval_conditions, hex_regex, may_hold_without_hits, of_them, render, scan_hits, wide_regex

RULES = [
    Rule("MatchCalc", (Pattern("MatchCalc", "$mz", "4D 5A", "hex"), Pattern("MatchCalc", "$calc", "calc.exe", nocase=True)), f"{at_offset('$mz', 0)} AND {of_them(['$calc'])}", "medium"),
    Rule("Beacon", (Pattern("Beacon", "$a", "beacon.dll"), Pattern("Beacon", "$b", "ReflectiveLoader")), of_them(["$a", "$b"], 2), "critical"),
    Rule("Wide", (Pattern("Wide", "$w", "Notepad", wide=True, ascii=False),), of_them(["$w"]), "low"),
    Rule("Over", (Pattern("Over", "$o", "aa"),), of_them(["$o"]), "low"),
    Rule("Many", (Pattern("Many", "$m", "[xy]z", "regex"),), of_them(["$m"]), "high"),
    Rule("ByName", (), "filename_lower like '%.ps1'", "high", ("script",), (("description", "scripts"),)),
]
FILES = {
    "/a/1.exe": b"MZ....CALC.EXE",
    "/a/2.exe": b".MZ...calc.exe",
    "/a/3.dll": b"beacon.dll",
    "/a/4.dll": b"beacon.dll ReflectiveLoader aaaa",
    "/a/5.txt": "Notepad".encode("utf-16-le"),
    "/a/6.txt": b"xz " * 60,
    "/a/7.PS1": b"",
    "/a/8.txt": None,
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("s", "h", "linux", p, bytearray(c) if c is not None else None, 1) for p, c in FILES.items()], "scan_id string, hostname string, os_type string, path string, content binary, event_timestamp_ms bigint")


@pytest.fixture(scope="module")
def found(corpus):
    hits = scan_hits(corpus, RULES)
    return fo.findings_agg(hits, eval_conditions(hits, RULES, corpus), RULES).cache()


def test_rules_that_fire(found):
    assert {(r["path"], r["rule"]) for r in found.collect()} == {("/a/1.exe", "MatchCalc"), ("/a/4.dll", "Beacon"), ("/a/4.dll", "Over"), ("/a/5.txt", "Wide"), ("/a/6.txt", "Many"), ("/a/7.PS1", "ByName")}


def test_overlaps_counts_and_caps(found, corpus):
    by = {(r["path"], r["rule"]): r for r in found.collect()}
    over = by["/a/4.dll", "Over"]
    assert over["match_count"] == 3 and over["offsets"] == ["28", "29", "30"] and over["first_offset"] == 28
    many = by["/a/6.txt", "Many"]
    assert many["match_count"] == 60 and len(many["offsets"]) == 50 and many["truncated"] and many["strings"] == ["xz"]
    assert [tuple(x) for x in many["string_ids"]] == [("$m", 60)]
    hits = scan_hits(corpus, RULES)
    unbounded = fo.findings_agg(hits, eval_conditions(hits, RULES), RULES, 0).where("rule = 'Many'").first()
    assert len(unbounded["offsets"]) == 60 and not unbounded["truncated"]
    alone = by["/a/7.PS1", "ByName"]
    assert alone["match_scope"] == "rule" and alone["match_count"] == 1 and not alone["truncated"]
    assert "scripts" in fo.rule_only_detail(found).where("rule = 'ByName'").first()["detail"]


def test_file_rows(found, corpus):
    rows = {r["filename"]: r for r in fo.file_rows(found, corpus).collect()}
    assert set(rows) == {"/a/1.exe", "/a/4.dll", "/a/5.txt", "/a/6.txt", "/a/7.PS1"}
    two = rows["/a/4.dll"]
    assert two["rule_count"] == 2 and two["match_total"] == 4 + 1 and two["severity"] == "Critical"
    assert sum(x["match_count"] for x in two["rules"]) == two["match_total"]
    assert fo.to_v2(fo.file_rows(found, corpus)).where("rule = 'Over'").count() == 3


def test_report_keeps_counts_over_budget(found):
    small = fo.rule_report(found, 1).where("rule = 'Over'").first()
    assert small["hits"] == 3 and small["dropped_lines"] == 1 and "3 hits in 1 files" in small["report"]


def test_render_and_hex():
    assert render(b"a\x00b\x00") == "ab" and render(b"\xff\xfe\x00") == "fffe00" and render(b"a\tb") == "a\tb"
    assert hex_regex("4D ?? [1-2] (01 | 02)") == b"M..{1,2}?(?:\x01|\x02)"


def test_one_pass_equals_the_steps(found, corpus):
    for cap in (50, 3, 0):
        hits = scan_hits(corpus, RULES)
        steps = fo.file_rows(fo.findings_agg(hits, eval_conditions(hits, RULES, corpus), RULES, cap), corpus)
        assert sorted(map(str, fo.scan(corpus, RULES, cap).collect())) == sorted(map(str, steps.collect()))


def test_findings_in_one_pass_equal_the_steps(found, corpus):
    for cap in (50, 3, 0):
        hits = scan_hits(corpus, RULES)
        steps = fo.findings_agg(hits, eval_conditions(hits, RULES, corpus), RULES, cap)
        assert sorted(map(str, fo.findings(corpus, RULES, cap).select(steps.columns).collect())) == sorted(map(str, steps.collect()))


def test_one_pass_never_shuffles_contents(corpus):
    plan = fo.scan(corpus, RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("MapInArrow") == 1
    assert "Exchange" not in fo.findings(corpus, RULES)._jdf.queryExecution().executedPlan().toString()


def test_a_large_pack_is_one_pass(corpus):
    pack = [Rule(f"R{i}", (Pattern(f"R{i}", "$a", f"beacon{'.dll' if i == 700 else i}"),), of_them(["$a"]), "low") for i in range(1000)]
    out = fo.scan(corpus, pack)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r["filename"], r["rules"][0]["rule"]) for r in out.orderBy("filename").collect()] == [("/a/3.dll", "R700"), ("/a/4.dll", "R700")]


def test_the_matcher_finds_what_a_search_finds():
    words = ["aa", "aba", "ab", "License", "bab"]
    pack = tuple(Pattern("r", f"${i}{n}", w, nocase=n) for i, w in enumerate(words) for n in (False, True))
    for data in (b"aabababaaLICENSElicenseLicense", b"", b"\xff\x00aa\xffAA", "é aa".encode()):
        got = sorted((p.id, at, raw) for p, at, raw in Matcher(pack).hits(data))
        want = sorted((p.id, at, data[at : at + len(p.pattern)]) for p in pack for at in range(len(data)) if (data.lower() if p.nocase else data)[at:].startswith(p.pattern.lower().encode() if p.nocase else p.pattern.encode()))
        assert got == want


def test_many_hits_of_a_file_keep_the_first(spark):
    corpus = spark.createDataFrame([("s", "h", "linux", "/x", bytearray(b"xz" * 30_000), 1)], "scan_id string, hostname string, os_type string, path string, content binary, event_timestamp_ms bigint")
    row = fo.findings(corpus, RULES).first()
    assert row["match_count"] == 30_000 and row["offsets"] == [str(2 * i) for i in range(50)] and row["truncated"]


def test_report_of_a_rule_with_many_files(spark):
    rows = [("s", "h", f"/f/{i:04d}", "R", 1, ["$a@1"]) for i in range(500)]
    df = spark.createDataFrame(rows, "scan_id string, hostname string, path string, rule string, match_count bigint, samples array<string>")
    row = fo.rule_report(df, 1000).first()
    size = len("/f/0000: 1 hits $a@1") + 1
    assert row["report"].split("\n")[1:] == [f"/f/{i:04d}: 1 hits $a@1" for i in range(1000 // size)] and row["dropped_lines"] == 500 - 1000 // size


def test_alerts_are_capped_in_order_of_time(spark):
    rows = [("s", f"/p{i % 7}/{i}", "R", 1000 - i) for i in range(900)] + [("t", "/x", "R", 1)]
    df = spark.createDataFrame(rows, "scan_id string, path string, rule string, event_timestamp_ms bigint")
    kept = [r["event_timestamp_ms"] for r in cap_alerts(df, 20).where("scan_id = 's' AND NOT suppressed").collect()]
    assert sorted(kept) == list(range(101, 121)) and cap_alerts(df, 20).count() == 901


def test_conditions_that_hold_without_hits(spark, corpus):
    negated = [
        Rule("NoCalc", (Pattern("NoCalc", "$c", "calc.exe", nocase=True),), "coalesce(n['$c'], 0) = 0", "high", ("t",), (("author", "me"),)),
        Rule("Not", (Pattern("Not", "$c", "calc.exe"),), "NOT (coalesce(n['$c'], 0) > 0) AND filename_lower LIKE '%.dll'"),
        Rule("Never", (Pattern("Never", "$c", "calc.exe"),), of_them(["$c"])),
        Rule("Named", (Pattern("Named", "$z", "zzz"),), "coalesce(filename, 'none') = '6.txt'"),
        Rule("Small", (Pattern("Small", "$z", "zzz"),), "file_size < 5 OR coalesce(n['$z'], 0) > 0"),
    ]
    assert [r.rule for r in may_hold_without_hits(spark, tuple(negated))] == ["NoCalc", "Not", "Named", "Small"]
    got = {(r["path"], r["rule"]): r for r in fo.findings(corpus, negated).collect()}
    quiet = set(FILES) - {"/a/1.exe", "/a/2.exe"}
    assert {p for p, r in got if r == "NoCalc"} == quiet and {p for p, r in got if r == "Not"} == {"/a/3.dll", "/a/4.dll"}
    assert {p for p, r in got if r == "Never"} == {"/a/2.exe"} and {p for p, r in got if r == "Named"} == {"/a/6.txt"} and {p for p, r in got if r == "Small"} == {"/a/7.PS1", "/a/8.txt"}
    one = got["/a/3.dll", "NoCalc"]
    assert one["match_scope"] == "rule" and one["match_count"] == 1 and one["severity"] == "high" and one["tags"] == ["t"] and one["meta"] == {"author": "me"}
    plan = fo.scan(corpus, negated)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


def forms_found(pack, data):
    """What a plain search from every start finds."""
    out = []
    for p in pack:
        for form in Matcher._forms(p):
            rx = re.compile(re.escape(form) if p.kind == "literal" else form, re.S | (re.I if p.nocase else 0))
            for at in range(len(data)):
                m = rx.match(data, at)
                if m and m.end() > at:
                    out.append((p.id, at, m.group()))
    return sorted(out)


def test_atoms_find_what_a_plain_search_finds():
    rnd = random.Random(5)

    def part(inner=False):
        k = rnd.random()
        if k < 0.5 or inner:
            return "".join(rnd.choice("abcAB") for _ in range(rnd.randint(1, 3)))
        if k < 0.8:
            return rnd.choice(["[ab]", "[^a]", ".", "b.?", "a{0,5}", "c.{1,3}a", r"\w", "(?i:ab)", r"\b"])
        if k < 0.9:
            return f"(?:{part(True)}|{part(True)})"
        return f"({part(True)}){rnd.choice(['+', '*', '?', '{2}', '{1,3}', '+?'])}"

    found = 0
    for _ in range(400):
        pack = []
        for i in range(5):
            kind, nocase = rnd.choice(["regex", "regex", "literal", "hex"]), rnd.random() < 0.3
            text = {"regex": "".join(part() for _ in range(rnd.randint(1, 4))), "literal": rnd.choice(["a", "ab", "bca", "AB"]), "hex": rnd.choice(["61 62 [1-2] 63", "( 61 | 62 63 ) 41", "6? 61 62", "61 ?? 62 63", "62 [0-3] ( 61 61 | 42 ) 63"])}[kind]
            pack.append(Pattern("r", f"${i}", text, kind, nocase))
        data = bytes(rnd.choice(b"aabbcABC\x00") for _ in range(rnd.randint(0, 60)))
        got = sorted((p.id, at, raw) for p, at, raw in Matcher(tuple(pack)).hits(data))
        found += len(got)
        assert got == forms_found(pack, data), (pack, data)
    assert found > 2000


def test_wide_expressions():
    pack = (Pattern("r", "$w", r"a[b-d]+(?:x|yz)?\d{2}", "regex", wide=True), Pattern("r", "$v", "AB.", "regex", nocase=True, wide=True, ascii=False))
    text = "abcx12 ACab1 abd34 abz"
    for data in (text.encode(), text.encode("utf-16-le"), b"\x00" + text.encode("utf-16-le")):
        got = sorted((p.id, at, raw) for p, at, raw in Matcher(pack).hits(data))
        assert got == forms_found(pack, data)
    assert {p.id for p, _, _ in Matcher(pack).hits(text.encode("utf-16-le"))} == {"$w", "$v"}
    with pytest.raises(ValueError):
        wide_regex(rb"a(?=b)")


def test_a_thousand_expressions_take_one_pass():
    pack = tuple(Pattern("r", f"$x{i}", f"tok{i:04d}[0-9a-f]{{4,8}}", "regex") for i in range(500)) + tuple(Pattern("r", f"$y{i}", f"AB {i % 256:02X} {i // 256:02X} ?? [1-3] CD", "hex") for i in range(500))
    matcher, data = Matcher(pack), b"word tok0123abcd12 foo bar baz " * 30_000
    assert not matcher.alone
    began = time.process_time()
    assert sum(1 for _ in matcher.hits(data)) == 30_000
    assert time.process_time() - began < 5


def test_ties_across_hosts_are_capped_the_same_way_each_time(spark):
    rows = [("s", f"h{i}", "/p", "R", 5) for i in range(40)]
    df = spark.createDataFrame(rows, "scan_id string, hostname string, path string, rule string, event_timestamp_ms bigint")
    for n in (1, 3, 7):
        kept = {r["hostname"] for r in cap_alerts(df.repartition(n), 3).where("NOT suppressed").collect()}
        assert kept == {"h0", "h1", "h10"}


def test_hits_are_given_on_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from fleetscan.operators import scan as sc

    rules = [sc.Rule("R", (sc.Pattern("R", "$a", "x"),), sc.of_them(["$a"]), "low")]
    rows = [("s", "h", f"/{i}", b"x" * n) for i, n in enumerate((0, 5, 3 * sc.HELD, 7, sc.HELD, 9))]
    files = spark.createDataFrame(rows, "scan_id string, hostname string, path string, content binary")
    want = {p: len(c) for _, _, p, c in rows if c}
    assert {r["path"]: r["count"] for r in sc.scan_hits(files, rules).groupBy("path").count().collect()} == want
    assert {r["path"]: (r["match_count"], len(r["sample_rows"])) for r in sc.scan_files(files, rules, sample_cap=0).collect()} == {p: (n, n) for p, n in want.items()}
    # What one batch of files gives leaves the task in several.
    tasks, kind = [], type(files)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: (tasks.append(f), plain(self, f, *a, **k))[1])
    sc.scan_hits(files, rules), sc.scan_files(files, rules, sample_cap=0)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["scan_id", "hostname", "path", "content"])
    assert [b.num_rows for b in tasks[0](iter([batch]))] == [sc.HELD] * 4 + [21]
    alone = batch.append_column("alone", pa.array([[]] * len(rows), pa.list_(pa.string())))
    assert [b.num_rows for b in tasks[1](iter([alone]))] == [2, 2, 1]


def test_hits_apart_are_those_of_a_search():
    """For literals, expressions with and without atoms, and strings of two forms."""
    rnd = random.Random(8)
    each = [("aa", "literal"), ("aba", "literal"), ("(?:ab|ba)[ab]*", "regex"), ("[ab]c?[ab]", "regex"), ("b?abc|c.?ab", "regex")]
    patterns = tuple(Pattern("R", f"${i}", p, k) for i, (p, k) in enumerate(each))
    two = (Pattern("R", "$t", "aab"), Pattern("R", "$t", "abc?", "regex"))
    inside = 0
    for _ in range(200):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 60)))
        matcher = Matcher(patterns + two)
        got, every = list(matcher.apart(data)), list(matcher.hits(data))
        for p in patterns:
            assert [(at, raw) for q, at, raw in got if q is p] == [(m.start(), m.group()) for m in re.finditer(p.pattern.encode(), data)]
        assert [(at, raw) for q, at, raw in got if q.id == "$t"] == [(m.start(), m.group()) for m in re.finditer(b"aab|abc?", data)]
        inside += len(every) - len(got)
    assert inside
