"""Conversation tries, page texts and phrases against brute force."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from fleetscan.llm import collocations, html_text, trie
from fleetscan.llm.queries import QUERIES

# --- conversation trie ------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def plain_trie(rows, forked=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], (r, x)))
    own = {c: [z[2] for z in sorted(v)] for c, v in own.items()}
    conv = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        conv[c] = own.get(base, [])[:h] + v[h:] if forked else v
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, v in conv.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, sum(below[k][1] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0))
    out = []
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(conv[c]) == len(p))))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def base_and_keep(forked):
    c = F.col("conv_id")
    return (c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6) if forked else (c, F.lit(0))


def trie_of(df, forked=True, **how):
    turns, who = trie.rebuilt(df, *base_and_keep(forked))
    return sorted([tuple(r) for r in trie.prefix_trie(turns, who, **how).collect()], key=str)


def some_conversations():
    rnd = random.Random(1)
    rows = []
    for c in [*range(40), *range(100, 130), -5, 205, 207, 208, 301, 302, 300]:
        rows += [(c, rnd.choice([t, t, None]), rnd.choice(["user", None]), rnd.choice(["a", "bb", None, "ccé"])) for t in range(rnd.choice([1, 2, 3, 4, 9, 13]))]
    for c in range(900, 940):
        rows += [(c, t, "user", "same") for t in range(20)]
    return [*rows, (None, 1, "a", "b"), (960, 1, "user", "same"), (960, 1, "user", "same"), *((970, t, "user", f"t{t}") for t in range(60))]


@pytest.mark.parametrize("segment,limit,block", [(4, 10, 7), (256, 1 << 16, 1 << 16), (1, 4, 5)])
def test_trie_by_segments_and_bursts(spark, segment, limit, block):
    rows = some_conversations()
    df = spark.createDataFrame(rows, CONV).repartition(4)
    assert trie_of(df, segment=segment, limit=limit, block=block) == plain_trie(rows)


def test_trie_of_plain_conversations(spark):
    rows = some_conversations()
    assert trie_of(spark.createDataFrame(rows, CONV), forked=False, segment=5, limit=30) == plain_trie(rows, forked=False)


def test_trie_odd_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert trie_of(empty) == [] and trie_of(spark.createDataFrame([(None, 1, "a", "b")], CONV)) == []
    # A role and a text never run into each other, and turnless conversations count at the root.
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(0, 1, "ab", "c"), (200, 1, "a", "bc"), (turnless + 300, 1, None, None), (400, None, None, "x" * 1_000_000), (400, None, "", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, CONV).select("*", F.lit(1).alias("TEXT_"), F.lit(2).alias("at"), F.lit(3).alias("tid"), F.lit(4).alias("head"))
    assert trie_of(df) == plain_trie(rows)


def test_trie_bounds_what_a_task_gets(spark):
    """One prefix of very many conversations is burst until no container is larger than allowed."""
    rows = [(c, t, "u", f"{t if t < 3 else c * 7 % 50 if t == 3 else c}") for c in range(300) for t in range(6)]
    turns, who = trie.rebuilt(spark.createDataFrame(rows, CONV), *base_and_keep(False))
    members = trie.segments(turns, who, 256)
    suffixes = members.select("*", F.lit(1).alias("n"), F.col("conv_id").alias("m"))
    sizes = trie.burst(suffixes, 40).where("key IS NOT NULL").groupBy("key").agg(F.sum(F.size("tids") - F.col("j") + 1).alias("w")).agg(F.max("w")).first()[0]
    assert sizes <= 40


# --- page texts ---------------------------------------------------------------------------------------


class Plain(HTMLParser):
    """The text of the article element, blocks parted by white space."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.out.append("" if tag == "b" else " ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.out.append("" if tag == "b" else " ")

    def handle_data(self, data):
        self.out.append(data if self.inside else "")


def test_texts_of_all_pages(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op12_html_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == " ".join("".join(Plain(pages[r["page_id"]]["html"] or "").out).split()) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "This sentence is long enough to be the text of an article and to surge over its neighbours. "
PAGES = [
    # Everything that is beside the article, in elements, roles, classes and ids.
    (
        f"""<!DOCTYPE html><html><head><title>x</title><meta charset=utf-8><style>p{{}}</style><body class="has-sidebar"><header class=site><h1>Site</h1></header><div role="navigation">menu</div>
        <div id="cookie-notice">We use cookies <button>ok</button></div><main><article class="post"><header><h1>Title</h1></header><p>One &amp; two<br>three&nbsp;four<p class="ad">buy<p>Fi<b>v</b>e
        six</p><div class="adSlot"><div>deep</div></div><aside>side</aside><form><input>q<select><option>1</select></form><script>if (a<b) "</p>"</script><noscript>no</noscript><p>a < b</p>
        <section id="comments"><article class="comment"><p>me too</p></article></section><footer>by</footer></article></main><div class="sidebar"><p>{LONG}</p></div><footer>&copy;</footer></body></html>""",
        "Title One & two three four Five six a < b",
    ),
    # No named article: text surges over menus and links, and dives where nothing is left.
    (f"<div><a href=/>home</a></div><div><a>x</a></div><h1>T</h1><p>{LONG * 2}</p><p>short</p><ul><li>item</ul><div class='comments'>c</div><div></div><div></div><div><a>f</a></div>", f"T {LONG * 2}short item"),
    # Of several articles the one with most text.
    (f"<article><p>teaser</p></article><article><p>{LONG}</p><p>end</p></article><article>other</article>", f"{LONG}end"),
    ("<article>only</article>", "only"),
    ("<p>only", "only"),
    ("<ul><li class='ad'>x<div>y</div></ul><p>content</p><p class='promo'>z<div>end</div>", "content end"),
    ("<head><title>t</title><p>unclosed head", "unclosed head"),
    ("plain text &lt; &#x41;&#66;", "plain text < AB"),
    ("<table><tr><td>a<td>b</table><h2>c</h2>d", "a b c d"),
    ("<p>x<!-- <p>y --><![CDATA[z]]><?php echo 1 ?></p><p hidden>h<p style='display: none'>n<p aria-hidden=true>m", "x"),
    ("<nav>menu", ""),
    ("", ""),
    (None, ""),
    ("<", "<"),
    ("<p", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_article_and_what_is_beside_it(page, want):
    assert html_text.main_text(page or "") == " ".join(want.split())


def test_surges_and_dives():
    assert html_text.stretches([0, 5, 0, 90, 0, 0, 0, 0, 100, 3], 3, 86) == [(1, 4), (6, 10)]
    assert html_text.stretches([1, 0, 0, 0, 1], 3, 1) == [(0, 1), (2, 5)]
    assert html_text.stretches([], 3, 1) == [] and html_text.stretches([0, 0], 3, 1) == []


def test_pages_odd_rows(spark):
    rows = [(i, p) for i, (p, _) in enumerate(PAGES)] * 2
    df = spark.createDataFrame(rows, "page_id long, html string").select("*", F.lit(9).alias("text_"), F.lit("u").alias("url"))
    got = html_text.extract(df).collect()
    assert got[0].__fields__ == ["page_id", "html", "text_", "url", "text"] and Counter((r["page_id"], r["text"]) for r in got) == Counter({(i, " ".join(t.split())): 2 for i, (_, t) in enumerate(PAGES)})
    assert html_text.extract(df.where("page_id < 0")).collect() == []
    replaced = html_text.extract(df.withColumn("text", F.lit("old"))).where("page_id = 3").first()
    assert replaced["text"] == "only"


def test_pages_of_megabytes_take_little_time():
    began = time.process_time()
    for page in ('<a "' * 300_000, '<a b="' * 300_000, "<script>" * 200_000, "<!--" * 200_000, '<p class="ad">' * 100_000, "<" * 500_000, "<article>" * 100_000, "<p>" * 200_000, '<div class="' + "a-" * 300_000 + '">x', "&amp;" * 300_000):
        html_text.main_text(page)
    whole = "<article>" + "<p>word &amp; word</p>" * 100_000 + "</article>"
    assert html_text.main_text(whole) == " ".join(["word & word"] * 100_000)
    assert time.process_time() - began < 60


# --- phrases ------------------------------------------------------------------------------------------


def plain_phrases(docs, least, longest, top):
    out = []
    by_lang = defaultdict(list)
    for lang, text in docs:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        by_lang["und" if lang is None else lang] += [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", lowered)]
    for lang, pieces in by_lang.items():
        n = sum(map(len, pieces))
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        often = {p for p in f if 2 <= len(p) and f[p] >= least}
        rows = []
        for p in often:
            if any(len(q) > len(p) and 100 * f[q] >= 100 * f[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in often):
                continue
            score, _, left, right = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def some_docs(seed, n=300):
    rnd = random.Random(seed)
    words = ["the", "The", "a", "of", "é", "x-1", "日本", "<b>", "in"]
    passage = "we hold these truths to be self evident"
    docs = []
    for i in range(n):
        parts = [rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rnd.randint(0, 40))]
        if i % 6 == 0:
            parts.insert(rnd.randint(0, len(parts)), f" {passage} ")
        docs.append((i if i % 9 else None, rnd.choice(["en", "en", "de", None, ""]), None if i % 50 == 3 else "".join(parts)))
    return docs


@pytest.mark.parametrize("how", [{}, {"share": 0.0}, {"share": 1.0, "lowered": 1.0}, {"bits": 8}, {"bits": 10, "block_bytes": 50}, {"share": 0.1, "lowered": 2.0}])
def test_phrases_whatever_the_sample_sets_and_blocks(spark, how):
    docs = some_docs(4)
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    for least, longest, top in ((12, 5, 2000), (20, 3, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, least=least, longest=longest, top=top, **how).collect())
        assert got == plain_phrases([d[1:] for d in docs], least, longest, top)
    assert any("hold these truths" in r[2] for r in plain_phrases([d[1:] for d in docs], 12, 5, 2000))


def test_what_the_sample_misses_is_found_by_expansion(spark):
    """Passages that no sampled document has."""
    rows = [(i, "en", "one two three four five six" if i % 4 else "seven eight, nine") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    missed = df.where(~collocations.hash_fraction([F.col("doc_id")], 1 / 8, "phrases") | (F.col("doc_id") % 4 == 0))
    docs = [(r["lang"], r["text"]) for r in missed.collect()]
    got = sorted(tuple(r) for r in collocations.collocations(missed, least=20).collect())
    assert got == plain_phrases(docs, 20, 5, 2000) and "two three four five six" in {r[2] for r in got}


def test_phrases_odd_rows(spark):
    ddl = "doc_id long, lang string, text string"
    empty = spark.createDataFrame([], ddl)
    assert collocations.collocations(empty).count() == 0 and collocations.collocations(spark.createDataFrame([(1, None, None), (2, "en", ""), (3, "en", " .,\n")], ddl)).count() == 0
    rows = [(1, "en", "a b " * 250_000), (1, "en", "c d. " * 200), (1, "en", "c d. " * 200), (None, None, "e\tf;" * 150)]
    df = spark.createDataFrame(rows, ddl).select("*", F.lit("x").alias("phrase"), F.lit(1).alias("n"), F.lit(2).alias("key"), F.lit(3).alias("h"))
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == plain_phrases([r[1:] for r in rows], 100, 5, 2000)


def test_scores_past_64_bits(spark):
    """1000 * a * n and l * r beyond 2^63 are exact."""
    a, n, left, right = 3_000_000_001, 9_000_000_000_007, 4_000_000_003, 7_000_000_009
    got = spark.createDataFrame([(a, n, left, right)], "a long, total long, l long, r long").selectExpr(f"{collocations.SCORE} AS s").first()[0]
    assert got == 1000 * a * n // (left * right)


def test_not_each_task_gives_the_text_of_each_frequent_phrase(spark, monkeypatch):
    """Rows of text are by the tasks of the sample, and those of phrases it lacks, not by all tasks."""
    text, only = "one two three four five six", "seven eight nine"
    df = spark.range(800).selectExpr("id AS doc_id", "'en' AS lang", f"'{text}' AS text").repartition(40)
    left_out = df.where(~collocations.hash_fraction([F.col("doc_id")], collocations.SAMPLE, "phrases")).limit(120).withColumn("text", F.lit(only))
    docs = df.unionByName(left_out)
    made, kind = {}, type(df)
    plain = kind.mapInArrow

    def counted(self, run, schema, *args, **how):
        rows = made.setdefault(schema, spark.sparkContext.accumulator(0))

        def counting(batches):
            for b in run(batches):
                rows.add(b.num_rows)
                yield b

        return plain(self, counting, schema, *args, **how)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    got = {r["phrase"]: r["n"] for r in collocations.frequent(docs.withColumnRenamed("doc_id", "key"), bits=16).collect()}
    parts = lambda t: {" ".join(t.split()[i:j]) for i in range(6) for j in range(i + 1, min(i + 5, len(t.split())) + 1)}
    assert got == {p: 800 for p in parts(text)} | {p: 120 for p in parts(only)} | {"": 800 * 6 + 120 * 3}
    with_text = sum(a.value for schema, a in made.items() if "phrase" in schema)
    assert len(parts(text)) == 20 and with_text < 40 * len(parts(text)) / 2


def test_no_text_is_shuffled_in_the_counting_pass(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    plan = collocations.hash_counts(df, collocations.bit_set(None, 8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "text" not in next(x for x in plan.split("\n") if "Exchange" in x)
    assert html.unescape("&amp;") == "&"


# --- licence windows ----------------------------------------------------------------------------------


def edited_templates(n):
    """Templates with filler put in and left out, in other words."""
    from fleetscan.llm import license_scan

    rnd, filler = random.Random(2), sorted(license_scan.FILLER)
    for _ in range(n):
        _, t = rnd.choice(license_scan.TEMPLATES)
        out = []
        for x in t.split(" "):
            if x.lower().strip(".,;") in license_scan.FILLER and rnd.random() < 0.2:
                continue
            out.append(x)
            if rnd.random() < rnd.choice([0, 0.1, 0.5]):
                out += [rnd.choice(filler) for _ in range(rnd.randint(1, 6))]
        yield "words here " * rnd.randint(0, 3) + " ".join(out) + " license and more words" * rnd.randint(0, 2)


def test_no_notice_is_dropped_by_what_it_saves(spark):
    from fleetscan.llm import license_scan

    one, all_ = license_scan.Scanner(license_scan.TEMPLATES), license_scan.Scanner(license_scan.TEMPLATES)
    all_.least = [-(10**9)] * len(all_.each)
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    notices = 0
    for t in [*texts, *edited_templates(2000)]:
        got, want = license_scan.scan_text(t, one), license_scan.scan_text(t, all_)
        assert got == want, t
        notices += len(want[1])
    assert notices > 1500


def test_the_bytes_saved_decide():
    """What saves most is kept, and what saves too little isn't confirmed."""
    from fleetscan.llm import license_scan

    text = "Released under the MIT License."
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    (best,) = scanner.notices(text)
    assert text[best["start"] : best["end"]] == "Released under the MIT License"
    scanner.ranked = lambda *a: license_scan.Scanner.ranked(scanner, *a)[::-1]
    assert [(n["start"], n["end"]) for n in scanner.notices(text)] != [(best["start"], best["end"])]
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    scanner.least = [10**9] * len(scanner.each)
    assert scanner.notices(text) == []


# --- more of other operators ----------------------------------------------------------------------------


def test_digests_of_packed_pieces(spark, sf_dir):
    from fleetscan.llm import tokens

    enc = tokens.encoder(tokens.default_tokenizer())
    ids = {r["doc_id"]: enc.whole([r["text"] or ""])[0] + bytes(4) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = Counter()
    for r in QUERIES["op1_packing"](spark, sf_dir).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) // 4 and r["ids_crc32"] == zlib.crc32(own[4 * r["start"] : 4 * (r["start"] + r["length"])])
        seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(b) // 4 for i, b in ids.items())


def test_texts_of_a_megabyte_in_fingerprints_scores_ledgers_and_archives(spark, sf_dir):
    from fleetscan.llm import ledger, quality, simhash, warc
    from fleetscan.llm.common import in_fold, read_table, work_path

    rnd = random.Random(4)
    long = " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(200_000))
    texts = {1: long, 2: long, 3: "short text of a few words", 4: "x" * 1_500_000, 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got[1] == got[2] == 1 and len({got[i] for i in (1, 3, 4)}) == 3
    rows = {r["doc_id"]: r for r in ledger.ledger(df).collect()}
    assert rows[1]["n_words"] == 200_000 and rows[1]["word_chars"] == len(long) - 199_999 and rows[4]["word_chars"] == 1_500_000
    docs = read_table(spark, sf_dir, "documents")
    scores = quality.scored(df, quality.train(docs, read_table(spark, sf_dir, "labels"), ~in_fold("doc_id", 5, 0))).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores) and len({r["score"] for r in scores if r["doc_id"] < 3}) == 1
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    read = {r["page_id"]: r for r in warc.read_records(warc.write_bundles(pages, work_path(spark, "warc"))).collect()}
    assert read[2]["refers_to"] == 1 and bytes(read[1]["payload"]).decode() == long and read[4]["payload_bytes"] == 1_500_000
