"""Operators against brute force, exact round trips and held-out accuracy."""

import datetime
import hashlib
import ipaddress
import itertools
import json
import re
import string
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetscan.llm import decontam, langid, ledger, license_scan, packing, pii, quality, simhash, token_store, tokens, warc
from fleetscan.llm.common import in_fold, open_fs, work_path
from fleetscan.llm.queries import ORACLE_SQL, QUERIES

ODD = [None, "", " ", "  a   b ", "a\n b\t\tc", "don't 's <|endoftext|> x", "é ü ñ 日本語 🎉", "x" * 300, "!!! ### \x1c y", "A  B  \n\n C"]


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck, compare):
    compare(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df())


# --- tokens, packing, token store -------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Zé.,'s!1\n\t 日\x1c"), max_size=25), min_size=1, max_size=6))
def test_runs_give_the_ids_of_whole_texts(texts):
    enc = tokens.encoder(tokens.default_tokenizer())
    ids, at = enc.encode(texts)
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == enc.whole(texts)


def test_odd_texts_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_RUNS", 5)
    enc = tokens.RunEncoder(tokens.default_tokenizer())
    for _ in range(2):
        ids, at = enc.encode(ODD)
        assert [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == enc.whole([t or "" for t in ODD])


def check_packing(rows, docs, tiers=packing.TIERS):
    enc = tokens.encoder(tokens.default_tokenizer())
    want = Counter((i, enc.whole([t or ""])[0] + b"\0\0\0\0") for i, t in docs)
    by_doc, windows = {}, {}
    for r in rows:
        assert r["length"] > 0 and len(r["token_ids"]) == 4 * r["length"]
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for own in windows.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["capacity"] and at & (at - 1) == 0 and at <= tiers[-1]
        total += at
    assert total == sum(len(b) // 4 * n for (_, b), n in want.items())
    if all(n == 1 for n in want.values()) and len({i for i, _ in docs}) == len(docs):
        got = {k[0]: b"".join(bytes(r["token_ids"]) for r in sorted(v, key=lambda r: r["start"])) for k, v in by_doc.items()}
        assert got == {i: b for i, b in want}
        for v in by_doc.values():
            v.sort(key=lambda r: r["start"])
            assert [r["start"] for r in v] == np.cumsum([0] + [r["length"] for r in v[:-1]]).tolist()


def test_packing_whole_table(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    check_packing(packing.pack_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_in_blocks_and_steps(spark, sf_dir, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in docs_of(spark, sf_dir).collect()]
    import pyarrow as pa

    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs[k : k + 30]], "__text": [t for _, t in docs[k : k + 30]]}) for k in range(0, len(docs), 30)]
    rows = [r for b in packing._pack_task(iter(batches), ["doc_id"], tokens.default_tokenizer(), packing.TIERS, 0, 4096, 3) for r in b.to_pylist()]
    check_packing(rows, docs)
    groups = {}
    for s, cap, step in {(r["sequence_id"], r["capacity"], r["step_id"]) for r in rows}:
        groups.setdefault(step, []).append(cap)
    assert all(len(set(g)) == 1 and sum(g) <= 4096 for g in groups.values())


def test_steps_of_long_and_short_documents_are_balanced(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{k}" for k in range(int(rng.choice([30, 60, 700, 2500]))))) for i in range(200)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs[k : k + 9]], "__text": [t for _, t in docs[k : k + 9]]}) for k in range(0, len(docs), 9)]
    rows = [r for b in packing._pack_task(iter(batches), ["doc_id"], tokens.default_tokenizer(), packing.TIERS, 0, 8192, 0) for r in b.to_pylist()]
    check_packing(rows, docs)
    size, cost, cap = Counter(), Counter(), {}
    for r in rows:
        size[r["step_id"]] += r["length"]
        cost[r["step_id"]] += r["length"] ** 2
        cap[r["step_id"]] = r["capacity"]
    assert max(Counter(cap[s] for s, n in size.items() if n < 8192).values(), default=0) <= 1
    own = [cost[s] for s, n in size.items() if n == 8192 and cap[s] == 1024]
    assert len(own) > 5 and max(own) < 1.5 * min(own)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").withColumn("start", F.lit("clash")).withColumn("__text", F.lit("x"))
    check_packing(packing.pack_documents(df).collect(), list(enumerate(ODD)))
    assert packing.pack_documents(df.limit(0)).count() == 0
    check_packing(packing.pack_documents(df.unionByName(df)).collect(), list(enumerate(ODD)) * 2)


def test_token_store_round_trip(spark, sf_dir):
    rows = sorted(QUERIES["op4_token_store"](spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    enc, at = tokens.encoder(tokens.default_tokenizer()), 0
    for r, d in zip(rows, docs_of(spark, sf_dir).orderBy("doc_id").collect(), strict=True):
        raw = enc.whole([d["text"] or ""])[0] + b"\0\0\0\0"
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4


def test_token_store_layout_and_selective_reads(spark, sf_dir):
    import pyarrow.parquet as pq

    path = work_path(spark, "t")
    token_store.write_tokens(docs_of(spark, sf_dir), path, row_group_bytes=200_000, page_bytes=4096)
    fs, inner = open_fs(path)
    files = [f"{inner}/{r['file']}" for r in token_store.reports(spark, path).collect()]
    assert sum(r["row_groups"] for r in token_store.reports(spark, path).collect()) > len(files)
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in meta) == docs_of(spark, sf_dir).count()
    columns = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for m in meta for i in range(m.num_columns)}
    ids = next(c for n, c in columns.items() if n.startswith("token_ids"))
    assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and all(c.has_column_index for n, c in columns.items())
    other = work_path(spark, "t")
    token_store.write_tokens(docs_of(spark, sf_dir), other, encoding="delta")
    one = pq.ParquetFile(f"{open_fs(other)[1]}/{token_store.reports(spark, other).first()['file']}").metadata.row_group(0)
    assert "DELTA_BINARY_PACKED" in one.column(2).encodings
    assert token_store.id_digests(spark, other).drop("file_part", "within").exceptAll(token_store.id_digests(spark, path).drop("file_part", "within")).isEmpty()
    read = token_store.read_tokens(spark, path).agg(F.sum(F.size("token_ids"))).first()[0]
    assert read == token_store.reports(spark, path).agg(F.sum("n_tokens")).first()[0]
    plan = token_store.read_tokens(spark, path).where("doc_id = 7").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan


def test_token_store_odd_rows(spark):
    df = spark.createDataFrame([(None, "b"), (2, None), (1, "x y"), (1, "x y"), (1, "")], "doc_id bigint, text string").withColumns({"n_tokens": F.lit(0), "file_part": F.lit(0), "__tie": F.lit(0)})
    path = work_path(spark, "t")
    token_store.write_tokens(df, path)
    rows = token_store.with_starts(token_store.read_tokens(spark, path), token_store.file_offsets(spark, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 1, 2] and [r["n_tokens"] for r in rows][0] == 2 and rows[4]["n_tokens"] == 1
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]).tolist()
    empty = work_path(spark, "t")
    token_store.write_tokens(df.limit(0), empty)
    assert token_store.id_digests(spark, empty).count() == 0 and token_store.read_tokens(spark, empty).columns == token_store.read_tokens(spark, path).columns


def test_token_store_files_grow_in_number_not_in_size(spark):
    # More input splits than shuffle partitions: a partition for each split.
    docs = spark.range(600).repartition(30).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), "id").alias("text"))
    path = work_path(spark, "t")
    token_store.write_tokens(docs, path)
    stored = token_store.read_tokens(spark, path)
    assert stored.select("file_part").distinct().count() > 20
    rows = token_store.with_starts(stored, token_store.file_offsets(spark, path)).orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]).tolist()


def test_token_store_reads_its_files_once_for_the_ids(spark, sf_dir):
    out = QUERIES["op4_token_store"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_text_of_a_megabyte(spark):
    text = " ".join(f"w{k % 5000},x" for k in range(150_000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    path = work_path(spark, "t")
    token_store.write_tokens(df, path)
    want = tokens.encoder(tokens.default_tokenizer()).whole([text])[0] + b"\0\0\0\0"
    rows = token_store.id_digests(spark, path).orderBy("doc_id").collect()
    assert (rows[0]["n_tokens"], rows[0]["ids_crc32"]) == (len(want) // 4, zlib.crc32(want))
    check_packing(packing.pack_documents(df).collect(), [(1, text), (2, "short")])


# --- near duplicates ----------------------------------------------------------------------------


def plain_fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            root[y] = x
    return [find(i) for i in range(len(a))]


def test_near_duplicates_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in docs_of(spark, sf_dir).orderBy("doc_id").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {docs[i][0]: (f"{f:016x}", docs[c][0]) for i, (f, c) in enumerate(zip(fps, plain_components(fps), strict=True))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, sf_dir).collect()} == want


def test_no_pair_in_the_radius_is_missed():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 31
    rng = np.random.default_rng(1)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not m & flips for m in masks)


def test_hot_buckets_are_divided_without_loss(spark):
    """A cloud of fingerprints that share most bits, chained by small steps."""
    rng = np.random.default_rng(5)
    base, fps = int(rng.integers(1 << 62)), set()
    for _ in range(400):
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 9), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint")
    want = plain_components(fps)
    for bound in (4096, 3):
        links = simhash.near_links(df, 4, bound).collect()
        root = {simhash.signed(f): simhash.signed(f) for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in links:
            root[find(u)] = find(v)
        parts, goal = {}, {}
        for i, f in enumerate(fps):
            parts.setdefault(find(simhash.signed(f)), set()).add(f)
            goal.setdefault(want[i], set()).add(f)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, goal.values()))


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long), (3, long.upper()), (9, None), (7, ""), (7, ""), (None, long), (1, "a b"), (2, "A  B"), (4, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("root", F.lit(1)).withColumn("__near_key", F.lit(2))
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got >= {(5, 3), (3, 3), (None, 3), (9, 7), (7, 7), (1, 1), (2, 1)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] != 4) == [1, 3, 7]
    hot = simhash.near_duplicates(df, hot_rows=1).select("doc_id", "fp", "component_id").collect()
    assert sorted(map(str, hot)) == sorted(str(r) for r in simhash.near_duplicates(df).select("doc_id", "fp", "component_id").collect())
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


# --- decontamination ----------------------------------------------------------------------------


def test_contamination_offsets_and_shards(spark, sf_dir):
    docs, items = docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = decontam.contamination(docs, items).collect()
    assert any(r["contaminated"] for r in one)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in one:
        for a, b, c, d in zip(r["hit_from"], r["hit_to"], r["char_from"], r["char_to"], strict=True):
            assert decontam.words_of(text[r["doc_id"]][c:d]) == decontam.words_of(text[r["doc_id"]])[a:b]
    several = decontam.contamination(docs, items, max_chars=60_000).collect()
    assert sorted(map(str, one)) == sorted(map(str, several))
    # Ids of more characters than that aren't broadcast.
    long = items.withColumn("item_id", F.concat(F.col("item_id").cast("string"), F.lit("-" * 300)))
    named = decontam.contamination(docs, long, max_chars=60_000).collect()
    assert sorted((r["doc_id"], r["n_hit"], [i.rstrip("-") for i in r["items"]]) for r in named) == sorted((r["doc_id"], r["n_hit"], r["items"]) for r in one)


def test_contamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "Alpha, beta!"), (2, None), (3, "..."), (2, "c d e f g h i j k l m"), (None, "solo")], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (3, "x ALPHA beta y alpha  beta"), (3, "x ALPHA beta y alpha  beta"), (4, "alphabeta"), (5, "b c d e f g h i j k l m n"), (6, "SOLO")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_hit", F.lit("x")).withColumn("__hit_row", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(df, items).collect()}
    assert got == {1: (0, 0, []), 2: (0, 0, []), 3: (6, 4, ["1"]), 4: (1, 0, []), 5: (13, 11, ["2"]), 6: (1, 1, ["null"])}
    clean = decontam.drop_contaminated(df, items)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 4]
    assert decontam.contamination(df, items.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(df.limit(0), items).count() == 0
    long = spark.createDataFrame([(1, "w " * 1_000_000 + "solo" + " w" * 10)], "doc_id bigint, text string")
    assert decontam.contamination(long, items).select("n_words", "n_hit", "char_from").first() == (1_000_011, 1, [2_000_000])


# --- language and quality -----------------------------------------------------------------------


def test_language_held_out(spark, sf_dir):
    got = QUERIES["op3_langid"](spark, sf_dir).join(docs_of(spark, sf_dir).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def plain_vector(text, idf):
    """The unit vector of a text by Python integers, gram by gram."""
    codes = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32]
    count = Counter()
    for n in (1, 2, 3):
        for at in range(len(codes) - n + 1):
            if any(c != 32 for c in (codes[at], codes[at + n - 1])):
                h = 0
                for k in range(n):
                    h = (h * 0x9E3779B97F4A7C15 + codes[at + k] + k + 1) * 0xBF58476D1CE4E5B9 % 2**64
                count[(h >> 40) % len(idf)] += 1
    v = {b: np.log(1 + c) * float(idf[b]) for b, c in count.items()}
    size = sum(x * x for x in v.values()) ** 0.5
    return {b: x / size for b, x in v.items()}


def test_language_by_the_nearest_of_all_centroids(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    model = langid.train(docs, ~in_fold("doc_id", 4, 2))
    assert len(set(model.languages)) > 2 and len(model.languages) > len(set(model.languages))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in QUERIES["op3_langid"](spark, sf_dir).collect():
        if not any(c.isalpha() for c in text[r["doc_id"]]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        v = plain_vector(text[r["doc_id"]], model.idf)
        cos = [sum(x * float(c[b]) for b, x in v.items()) for c in model.centroids]
        top = max(cos)
        near = {model.languages[i] for i, c in enumerate(cos) if c > top - 1e-5}
        assert r["lang_pred"] in near and abs(r["score"] - min(1, max(0, top))) < 1e-4
        floors = [langid.REJECT * model.floors[i] for i, c in enumerate(cos) if c > top - 1e-5]
        assert r["rejected"] in {top < f for f in floors} or min(abs(top - f) for f in floors) < 1e-4


def test_equal_cosines_and_frequent_languages(spark):
    c = np.eye(2, 8192, dtype=np.float32)
    c[1] = c[0]
    model = langid.LanguageModel(np.ones(8192, np.float32), ["aa", "bb"], c, np.zeros(2))
    df = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert langid.predict(df, model).first()["lang_pred"] == "aa"
    rows = [(i, f"{'the cat sat ' if i % 2 else 'le chat est '} {i}" * 5, "en" if i % 2 else "fr") for i in range(20)] + [(100 + i, "junk", f"z{i}") for i in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True), max_languages=2)
    assert set(model.languages) == {"en", "fr"}
    long = spark.createDataFrame([(1, "the cat sat " * 200_000)], "doc_id bigint, text string")
    assert langid.predict(long, model).first()["lang_pred"] == "en"


def test_language_odd_rows(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat sat on the mat " * 9, "en"), ("le chat est sur la table " * 9, "fr"), (None, "en"), ("", "en"), ("123 !!", "en"), ("the cat", None), ("le chat", "fr"), ("le chat", "fr")])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(df, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}
    assert got == {0: "en", 1: "fr", 2: "und", 3: "und", 4: "und", 5: "en", 6: "fr", 7: "fr"}
    assert langid.train(df.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    far = langid.predict(spark.createDataFrame([(1, "zzqx wvvk jjqz xxkq")], "doc_id bigint, text string"), model).first()
    assert far["rejected"]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def plain_stats(text):
    """The statistics as they are defined, by character and word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return dict.fromkeys(quality.STATS, 0.0)
    n, chars, threes = len(words), sum(len(w.encode()) for w in words), list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    of = lambda some: sum(c in some for c in text)
    upper, lower = of(string.ascii_uppercase), of(string.ascii_lowercase)
    return {
        "n_words": n, "mean_word": chars / n, "distinct_share": len(set(words)) / n, "top_word_share": max(map(words.count, set(words))) / n,
        "same_as_last_share": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "repeat_share": 1 - len(set(threes)) / (n - 2) if n > 2 else 0.0,
        "symbol_share": of("#*$%&<>@^~_=+{}[]\\") / n, "bar_share": of("|") / n, "bang_share": of("!") / n, "upper_share": upper / max(1, upper + lower), "digit_share": of(string.digits) / chars,
        "letter_share": (upper + lower + sum(ord(c) >= 0xC0 for c in text)) / chars, "dup_line_share": 1 - len(set(lines)) / len(lines), "words_per_line": n / len(lines),
        "capital_word_share": sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words) / n,
    }


def test_quality_by_plain_rules_over_plain_statistics(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model, again = (quality.train(d, labels, ~in_fold("doc_id", 5, 0)) for d in (docs, docs.orderBy(F.desc("doc_id"))))
    assert model == again and model.rules
    text = {r["doc_id"]: r["text"] for r in docs.where("n_chars < 6000").collect()}
    close = lambda a, b: abs(a - b) < 1e-9 * max(1, abs(b))
    for r in quality.scored(docs, model).collect():
        if r["doc_id"] in text:
            want = plain_stats(text[r["doc_id"]])
            assert all(close(r[s], v) for s, v in want.items()), {s: (r[s], v) for s, v in want.items() if not close(r[s], v)}
            z = model.bias + sum(w for rule, w in model.rules if all((r[s] <= t) == low for s, low, t in rule))
            assert close(r["score"], 1 / (1 + np.exp(-z)))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in QUERIES["op6_quality"](spark, sf).collect()}
    assert got == {r["doc_id"]: (r["score"], int(r["score"] >= 0.3)) for r in quality.scored(docs, model).collect()}


def test_quality_of_repeated_keys_is_the_same_each_time(spark):
    rows = [(i, f"word{i % 3} " * (i % 9 + 1) + f"v{v}" * v) for i in range(60) for v in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    models = [quality.train(spark.createDataFrame(x, "doc_id bigint, text string"), labels, F.lit(True)) for x in (rows, rows[::-1])]
    assert models[0] == models[1]


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.6)).astype(float)
    model = quality.fit(x, y, ("a", "b", "c"))
    assert 0 < len(model.rules) < 80
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    hold = [np.logical_and.reduce([(x[:, "abc".index(s)] <= t) == low for s, low, t in rule]) * w for rule, w in model.rules]
    assert np.allclose(got, 1 / (1 + np.exp(-(model.bias + sum(hold)))))
    assert ((got >= 0.5) == y).mean() > 0.97


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(1, "")], "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.train(df, none, F.lit(True))
    assert all(r["score"] == 0.5 for r in quality.scored(df, model).collect())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == df.count()
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 1), (None, 0)], "doc_id bigint, quality int")
    assert quality.train(df, labels, F.lit(True)).rules == ()
    assert quality.scored(df.limit(0), model).count() == 0


# --- personal data ------------------------------------------------------------------------------


def luhn(s):
    d = [int(x) for x in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def out_of(spark, *texts, key="a key of tests"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [(r["text"], r["pii"]) for r in pii.pseudonymize(df, key=key).orderBy("doc_id").collect()]


def test_feistel_permutes(spark):
    df = spark.range(1000).select(pii.feistel(F.col("id"), F.expr("40L"), F.expr("25L"), "k", "t").alias("v"))
    assert sorted(r[0] for r in df.collect()) == list(range(1000))
    days = spark.range(pii.CYCLE_DAYS).select(pii.feistel(F.col("id"), F.expr(f"{pii.DAYS_A}L"), F.expr(f"{pii.DAYS_B}L"), "k", "d").alias("v"))
    assert days.distinct().count() == pii.CYCLE_DAYS and days.agg(F.max("v")).first()[0] == pii.CYCLE_DAYS - 1
    digits = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("v"))
    assert sorted(r[0] for r in digits.collect()) == [f"{i:03d}" for i in range(1000)]


def test_formats_stay_valid_and_linked(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    text = f"card {card}, ip 10.1.2.3; +1 (212) 555-0199 born 1984-02-29, 31.12.1999 and 12/25/2020; ssn 123-45-6789 iban {iban} a.b@mail.example.com password=7602ad27cf5550de1c end"
    (new, found), (again, _), (other, _) = *out_of(spark, text, "x " + text), *out_of(spark, text, key="another")
    assert [s["kind"] for s in found] == ["card", "ip", "phone", "date", "date", "date", "ssn", "iban", "email", "keyed_secret"]
    assert again == "x " + new and other != new
    for s in found:
        assert text[s["start"] : s["start"] + s["length"]] not in new
    m = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}), ip ((?:\d+\.){3}\d+); \+1 \(\d{3}\) \d{3}-\d{4} born (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.\d{4} and (\d\d)/(\d\d)/\d{4}; ssn \d{3}-\d\d-\d{4} iban (DE\d\d(?: \d{4}){4} \d\d) u[0-9a-f]{16}@example\.invalid password=[0-9a-f]{18} end", new)
    assert m and luhn(m[1]) and all(int(x) < 256 for x in m[2].split("."))
    assert 1 <= int(m[4]) <= 12 and 1 <= int(m[7]) <= 12 and 1 <= int(m[8]) <= 12
    turned = (lambda s: s[4:] + s[:4])(m[10].replace(" ", ""))
    assert int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def test_what_is_not_valid_stays(spark):
    same = ["4111111111111112", "300.1.2.3", "2024-13-01 2023-02-29", "000-12-3456", "DE00 3704 0044 0532 0130 00", "token = \"x\" secret: abcdefghij", "version 1.2.3, 12345 items", "a@b", "", "plain"]
    assert [t for t, _ in out_of(spark, *same)] == same
    assert out_of(spark, None) == [(None, [])]
    df = spark.createDataFrame([(1, "x 10.0.0.1", "k")], "doc_id int, text string, __pii_m string")
    assert pii.pseudonymize(df).columns == ["doc_id", "text", "__pii_m", "pii"] and pii.pseudonymize(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymize(df.withColumn("PII", F.lit(1)))
    long = "word " * 30_000 + "10.0.0.1"
    assert out_of(spark, long)[0][0].startswith("word ") and "10.0.0.1" not in out_of(spark, long)[0][0]


def test_keyed_secrets_are_replaced_whole(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    long, letters = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(4))[:200], "correcthorse"
    forms = {
        "token={}, next": [long, jwt, letters, "hunter2!"],
        "token: {}. Next": [long, jwt, "hunter2!", "it's2good", "a/b,c;d9", "x1" * 50_000],
        '{{"password": "{}", "n": ""}}': ["abc12345", long, jwt, letters, "correct horse battery", "it's \\\"2\\\" good", "x\\\\" * 20_000],
        "{{'pwd' : '{}'}}": ["abc12345", 'a"b c"d9'],
        '"{{\\"api_key\\":\\"{}\\",\\"n\\":1}}"': ["abc12345", letters],
        "DB_PASSWORD  :=  {}": ["abc12345", letters],
        'token = "{}\nnext': ["hunter2!", long],
    }
    cases = [(form, v) for form, values in forms.items() for v in values]
    for (form, value), (new, found) in zip(cases, out_of(spark, *(f.format(v) for f, v in cases)), strict=True):
        left, right = form.format("\0").split("\0")
        assert [s["kind"] for s in found] == ["keyed_secret"], (form, value[:50])
        assert new.startswith(left) and new.endswith(right) and len(new) == len(form.format(value)), (form, value[:50])
        assert re.fullmatch("[0-9a-fA-F]+", new[len(left) : len(new) - len(right)]), (form, value[:50], new[:200])
    same = ["The secret: patience!", "token: well-known, and so on", 'a "token": "x"', "secret: something. More"]
    assert [t for t, _ in out_of(spark, *same)] == same
    (a, _), (b, _) = out_of(spark, f"token={long}1", f"token={long}2")
    assert a != b and len(set(re.findall(".{64}", a[6:]))) == 3


def plain_feistel(v, a, b, key, label):
    x, y = divmod(v, b)
    mix = lambda i, half, m: int(hashlib.sha256(f"{key}|{label}|{i}|{half}|{m}".encode()).hexdigest()[:15], 16) % m
    for i in range(8):
        x, y = ((x + mix(i, y, a)) % a, y) if i % 2 == 0 else (x, (y + mix(i, x, b)) % b)
    return x * b + y


def plain_digits(d, key, label):
    if len(d) > 18:
        return plain_digits(d[:18], key, label + "1") + plain_digits(d[18:], key, label + "2")
    n, low = len(d), len(d) // 2
    return d if n < 2 else str(plain_feistel(int(d), 10 ** (n - low), 10**low, key, label)).zfill(n)


def plain_value(kind, m, key):
    """A valid candidate's pseudonym, else None, by arithmetic of Python's own."""
    digits, sha = re.sub(r"\D", "", m), lambda *x: hashlib.sha256("|".join([key, *x]).encode()).hexdigest()

    def relay(layout, new):
        new = iter(new)
        return "".join(next(new) if c.isdigit() else c for c in layout)

    if kind == "card":
        body = plain_digits(digits[:-1], key, "card")
        return relay(m, next(body + c for c in "0123456789" if luhn(body + c))) if luhn(digits) else None
    if kind == "ip":
        parts = [int(x) for x in m.split(".")]
        return str(ipaddress.IPv4Address(plain_feistel(int.from_bytes(bytes(parts)), 65536, 65536, key, "ip"))) if max(parts) < 256 else None
    if kind == "phone":
        code = re.match(r"\+(?:\d{1,3}(?=[ .\-(])|\d)|", m)[0]
        return code + relay(m[len(code) :], plain_digits(re.sub(r"\D", "", m[len(code) :]), key, "phone"))
    if kind == "date":
        a, b, c = re.split(r"[-/.]", m)
        sep, form = re.search(r"[-/.]", m)[0], "ymd" if len(a) == 4 else "dmy" if "." in m or int(a) > 12 else "mdy"
        v = dict(zip(form, map(int, (a, b, c)), strict=True))
        try:
            n = datetime.date(v["y"], v["m"], v["d"]).toordinal() - datetime.date(1600, 1, 1).toordinal()
        except ValueError:
            return None
        lap, day = divmod(n, 146097)
        new = datetime.date.fromordinal(datetime.date(1600, 1, 1).toordinal() + lap * 146097 + plain_feistel(day, 189, 773, key, "date"))
        wide = 1 if 1 in (len(a), len(b)) else 2
        return sep.join(f"{new.year:04d}" if f == "y" else str(new.month if f == "m" else new.day).zfill(wide) for f in form)
    if kind == "ssn":
        numbers = [(x, y, z) for x, y, z in [map(int, m.split("-"))]][0]
        if not (0 < numbers[0] < 900 and numbers[0] != 666 and numbers[1] and numbers[2]):
            return None
        areas = [x for x in range(1, 900) if x != 666]
        n = plain_feistel((areas.index(numbers[0]) * 99 + numbers[1] - 1) * 9999 + numbers[2] - 1, 88902, 9999, key, "ssn")
        return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "iban":
        p = m.replace(" ", "")
        rest = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        if rest(p[4:] + p[:4]) != 1:
            return None
        body = relay(p[4:], plain_digits(re.sub(r"\D", "", p[4:]), key, "iban"))
        p = f"{p[:2]}{98 - rest(body + p[:2] + '00'):02d}{body}"
        return re.sub("(.{4})", r"\1 ", p).strip() if " " in m else p
    if kind == "email":
        return f"u{sha('email', m.lower())[:16]}@example.invalid"
    if kind == "keyed_secret":
        name = regex.match(f"(?:{pii._NAME}(?:{pii._EQUALS}|{pii._COLON}){pii._OPEN})", m, regex.ASCII)[0]
        end = 0 if not re.search(r"[\"'`]$", m) else 2 if name.endswith('\\"') else 1
        return name + plain_value("secret", m[len(name) : len(m) - end], key) + (m[-end:] if end else "")
    prefix = re.match("AKIA|gh[pousr]_|", m)[0]
    first, n = sha("secret", m), len(m) - len(prefix)
    raw = (first + sha("secret2", m) + "".join(sha("secret", str(i), first) for i in range(3, -(-n // 64) + 1)))[:n]
    return prefix + (raw.upper() if m.upper() == m else raw)


def plain_pseudonyms(text, key):
    """The text with its personal data replaced, and (kind, start, length) of each."""
    found = []

    def one(hit):
        for kind, pattern in pii.PATTERNS.items():
            if regex.fullmatch(pattern, hit[0], regex.ASCII) and (new := plain_value(kind, hit[0], key)):
                found.append((kind, hit.start(), len(hit[0])))
                return new
        return hit[0]

    return regex.sub(pii.ANY, one, text or "", flags=regex.ASCII), found


def test_pseudonyms_of_the_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in docs_of(spark, "/root/testdata/sf0.01").collect()}
    got = QUERIES["op7_pii"](spark, "/root/testdata/sf0.01").collect()
    key, kinds = pii.session_key(spark), Counter()
    assert len(got) == len(docs) and len(key) == 64 and key == pii.session_key(spark)
    for r in got:
        text, found = plain_pseudonyms(docs[r["doc_id"]], key)
        assert (r["text"] or "", r["n_found"]) == (text, len(found))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in found) for k in pii.KINDS]
        kinds.update(k for k, _, _ in found)
    assert {"card", "email", "ip", "phone", "keyed_secret"} <= set(kinds)


def test_pseudonyms_of_every_kind(spark):
    numbers = ["4111 1111 1111 1111", "378282246310005", "6304000000000000000", "10.0.0.1", "+49 30 1234 5678", "(212) 555-0123", "212-555-0123", "123-45-6789", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    dates = ["2350-01-02", "1/2/2024", "13/2/2024", "31.12.0099", "9999/12/31", "02/29/2000", "1599-12-31", "2/30/2024"]
    others = ["ghp_" + "a" * 36, "abcdef" * 6 + "abcd", "AKIA" + "A1" * 8, "a.b@x.com. Next", "a.b@x.com.5pm", "pwd=hunter2!!"]
    for x, (new, found) in zip([*numbers, *dates, *others], out_of(spark, *(f"so {x} on" for x in [*numbers, *dates, *others])), strict=True):
        want, spans = plain_pseudonyms(f"so {x} on", "a key of tests")
        assert (new, [(s["kind"], s["start"], s["length"]) for s in found]) == (want, spans), x
        assert (len(found) == 1 and x not in new) == (x != "2/30/2024"), x


def test_long_repeats_need_neither_stack_nor_time(spark):
    n = 100_000
    texts = ["x@" + "a." * n, "x@" + "a." * n + "com", "x@" + "-" * n, "a" * n + "@", "9" * n, "1.2.3." * n, "+1 " * n, "12/" * n, "2024-01-" * n, "DE12 " + "ABCD " * n, "DE12" + "3" * n, "token=" + "," * n + "x", "token: " + "a." * n + "9", "token:" * (n // 6), "token" + " " * n, 'password="' + "a" * n, "'pwd':'" + "\\" * n, "pwd=" + "'a" * n, "0f" * n, "ghp_" * n, "@" * n, "1-" * n]
    texts = [f"{t} 10.1.2.3" for t in texts]
    for text, (new, found) in zip(texts, out_of(spark, *texts), strict=True):
        assert plain_pseudonyms(text, "a key of tests") == (new, [(s["kind"], s["start"], s["length"]) for s in found]), text[:20]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op7_pii"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_key_is_in_no_plan_and_of_the_application(spark, sf_dir):
    key = pii.session_key(spark)
    out = QUERIES["op7_pii"](spark, sf_dir)
    out.write.format("noop").mode("overwrite").save()
    plans = out._jdf.queryExecution().toString() + out._jdf.queryExecution().executedPlan().toString() + out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    assert len(key) == 64 and key not in plans and "__pii_k" in plans
    other = spark.newSession()
    assert pii.session_key(other) == key
    df = "SELECT 1 AS doc_id, 'at 10.1.2.3' AS text"
    assert pii.pseudonymize(spark.sql(df)).collect() == pii.pseudonymize(other.sql(df)).collect()


# --- WARC, ledger, licences -----------------------------------------------------------------------


def test_warc_bundles_are_seekable(spark, tmp_path):
    import zstandard

    rows = [(i, f"http://x/{i}", "<p>" + f"line {i % 7} " * 200) for i in range(60)] + [(100, None, None), (101, "u\r\nv", "tiny"), (102, "u", "tiny"), (0, "again", "<p>" + "line 0 " * 200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("record_type", "__first", "__n", "payload_digest", "refers_to")}).coalesce(1)
    index = warc.write_bundles(df, f"file://{tmp_path}/w", frame_bytes=4096, bundle_bytes=20_000)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows) and index.select("bundle").distinct().count() > 1 and index.agg(F.max("frame")).first()[0] > 1
    by = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(j for j, _, g in rows if g == h)
        is_new = len(raw) < 100 or i == first
        want[i, "response" if is_new else "revisit", None if is_new else first, len(raw), hashlib.sha256(raw).hexdigest()] += 1
    assert by == want
    bundle = index.first()["bundle"].removeprefix("file://")
    raw = open(bundle, "rb").read()
    assert struct.unpack("<I", raw[-4:])[0] == warc.FOOTER
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 1 + index.where(F.col("bundle").endswith(bundle.rsplit("/", 1)[1])).count()
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in whole
    # Frames are dealt by the bytes of their records, each to one task.
    read = warc.read_records(index, payloads=False, read_bytes=4000)
    assert "payload" not in read.columns and len(set(read.select(F.spark_partition_id()).distinct().collect())) > 3
    assert Counter(map(str, read.collect())) == Counter(str(r) for r in warc.read_records(index).drop("payload").collect())
    assert warc.read_records(warc.write_bundles(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_ablations_by_bits(spark):
    rows = [(1, 0), (2, 1), (3, 3), (4, 4), (5, 64), (6, 64)]
    entries = spark.createDataFrame(rows, "doc_id bigint, failures bigint")
    got = {r["rule"]: (r["failed"], r["sole"], r["kept"]) for r in ledger.ablations(entries, "v2").collect()}
    assert got["few_words"] == (2, 1, 1) and got["repeated_windows"] == (1, 0, 1) and got["symbols"] == (1, 1, 1) and got["upper_case"] == (2, 2, 1)
    assert "long_words" not in got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    w = [x.encode() for x in words]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    assert ledger.repeated_words(w) == len(want)


def test_ledger_odd_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(1, "")], "doc_id bigint, text string").withColumn("failures", F.lit("x"))
    got = ledger.ledger(df).collect()
    assert len(got) == len(ODD) + 1 and all(r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", ODD[r["doc_id"]] or "")) for r in got)
    assert ledger.ledger(df.limit(0)).count() == 0


def test_licences(spark):
    cases = {
        "Released under the MIT License.": ["MIT"],
        "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!": ["MIT"],
        "This code is released under the terms of the MIT license": ["MIT"],
        "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "This work is licensed under the GNU General Public License, version 4.": [],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "He has a licence to drive and a copyright lawyer.": [],
        "All rights reserved.": ["All-Rights-Reserved"],
        ("filler " * 500 + "Released under the MIT License. " + "filler " * 500): ["MIT"],
        "a\n" * 50 + "Licensed under CC BY-NC 4.0.\nRest\nReleased under the MIT License.": ["CC-BY-NC-4.0", "MIT"],
        "": [],
    }
    df = spark.createDataFrame([*enumerate(cases), (99, None)], "doc_id int, text string").withColumn("notices", F.lit(0))
    got = {r["doc_id"]: [n["license"] for n in r["notices"]] for r in license_scan.scan_licenses(df).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases and got[99] == []
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def licences_of(text):
    return [n["license"] for n in license_scan.scan_text(text, license_scan.Scanner(license_scan.TEMPLATES))[1]]


def test_wrapped_notices():
    gpl = "This work is licensed under the GNU General Public\nLicense, version 3."
    for text in (gpl, gpl.replace("\n", "\r\n * "), "# x\n# " + gpl.replace(" ", "\n# "), "REM " + gpl.replace("\n", "\nREM ")):
        assert licences_of(text) == ["GPL-3.0"], text
    (one,) = license_scan.scan_text("intro\n\n" + gpl + "\nrest", license_scan.Scanner(license_scan.TEMPLATES))[1]
    assert (one["start"], one["end"]) == (7, 7 + len(gpl) - 1)
    mit = dict(license_scan.TEMPLATES[1:2])["MIT"]
    bsd = next(t for n, t in license_scan.TEMPLATES if t.startswith("Redistribution"))
    for name, text in (("MIT", mit), ("BSD-3-Clause", bsd)):
        for width in (1, 3, 7, 12):
            w = text.split(" ")
            assert licences_of("\n * ".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))) == [name]
    assert licences_of("It is under the GNU General Public License. 3 files follow.") == []


def test_several_notices_of_one_line():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    bsd = next(t for n, t in license_scan.TEMPLATES if t.startswith("Redistribution"))
    assert licences_of(f"{mit} {apache}") == ["MIT", "Apache-2.0"]
    for gap in (1, 15, 39, 70):
        assert licences_of(" x" * 80 + f" {mit}" + " x" * gap + f" {apache}" + " x" * gap + f" {bsd} {mit}" + " x" * 80) == ["MIT", "Apache-2.0", "BSD-3-Clause", "MIT"]
    notices = license_scan.scan_text(f"{mit} {apache}" * 3, license_scan.Scanner(license_scan.TEMPLATES))[1]
    assert len(notices) == 6 and all(a["end"] <= b["start"] for a, b in zip(notices, notices[1:], strict=False))


def test_every_template_is_tried():
    gnu = tuple((f"X-{i}", f"This work is licensed under the GNU General Public License, version {i}, see the terms of the license.") for i in range(20, 60))
    text = "It is licensed under the ISC License, see the file for the terms of the license"
    scanner = license_scan.Scanner(gnu + license_scan.TEMPLATES)
    assert [n["license"] for n in license_scan.scan_text(text, scanner)[1]] == licences_of(text) == ["ISC"]
    both = "This work is licensed under the GNU General Public License, version 3. All rights reserved."
    assert [n["license"] for n in license_scan.scan_text(both, scanner)[1]] == licences_of(both) == ["GPL-3.0", "All-Rights-Reserved"]


def test_public_notices_and_short_forms():
    gnu = "This {x} is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {n} Public License as published by\n# the Free Software Foundation, {v} of the License{o}"
    later = ", or\n# (at your option) any later version."
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    cases = {
        gnu.format(x="program", n="General", v="either version 3", o=later): ["GPL-3.0"],
        gnu.format(x="file", n="General", v="version 2", o="."): ["GPL-2.0"],
        gnu.format(x="library", n="Lesser General", v="either version 2.1", o=later): ["LGPL-2.1"],
        gnu.format(x="program", n="Affero General", v="either version 3", o=later): ["AGPL-3.0"],
        gnu.format(x="program", n="General", v="either version 4", o=later): [],
        "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": ["GPL-3.0"],
        mit: ["MIT"],
        "MIT License\n\nCopyright (c) 2020 X\n\n" + mit: ["MIT", "MIT"],
        bsd.format("1.", "2.") + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS": ["BSD-2-Clause"],
        bsd.format("*", "*") + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS": ["BSD-2-Clause"],
        bsd.format("1.", "2.") + "3. Neither the name of the copyright holder nor": ["BSD-3-Clause"],
        bsd.format("*", "*") + "* Neither the name of X nor": ["BSD-3-Clause"],
        "SPDX-License-Identifier: GPL-3.0": ["GPL-3.0"],
        "/* SPDX-License-Identifier: GPL-2.0-only */": ["GPL-2.0"],
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nx": ["MIT", "Apache-2.0", "BSD-3-Clause"],
        "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": ["GPL-2.0"],
        "<!-- SPDX-License-Identifier: Zlib -->": ["Zlib"],
        "SPDX-License-Identifier: NONE": [],
        '{"name": "x", "license": "ISC"}': ["ISC"],
        "License: GPLv3+": ["GPL-3.0"],
        "under LGPLv2.1 or the GPL v2": ["LGPL-2.1", "GPL-2.0"],
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
        "This work is licensed under the MIT/ISC License.": ["MIT", "ISC"],
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0"],
        "CC-BY-NC-ND-4.0": ["CC-BY-NC-ND-4.0"],
        "Er kam mit.\nLicensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "die mit license plates": [],
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": ["ISC"],
    }
    assert {t: licences_of(t) for t in cases} == cases
    for name, t in license_scan.TEMPLATES:
        assert licences_of(t) == [name] or name == "Unlicense", (name, t)
        assert license_scan.CANDIDATE.search(t) or name in ("MIT", "ISC"), t


def test_licence_counts(spark, sf_dir):
    marks = {"MIT": "mit license", "GPL-3.0": "gnu general public license, version 3", "Apache-2.0": "apache license, version 2.0", "CC-BY-NC-4.0": "cc by-nc 4.0"}
    docs = docs_of(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: set(r["licenses"].split(",")) for r in QUERIES["op10_licenses"](spark, "/root/testdata/sf0.01").collect()}
    for name, mark in marks.items():
        want = {r["doc_id"] for r in docs.where(F.lower("text").contains(mark)).collect()}
        assert want and want <= {i for i, x in got.items() if name in x}


def shared_words(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, old=row, x=x: old[j - 1] + 1 if x == b[j - 1] else max(left, old[j]), initial=0))
    return row[-1]


def plain_notices(text):
    """(licence, start, end) from the first to the last meaningful word of all exact wordings,
    each template held against each place of the text."""
    words = [(license_scan.plain(m[0]), *m.span()) for m in license_scan._TOKEN.finditer(text)]
    heavy = [k for k, w in enumerate(words) if w[0] not in license_scan.FILLER]
    out = set()
    for name, t in license_scan.TEMPLATES:
        want = license_scan.tokens(t)
        core = [k for k, w in enumerate(want) if w not in license_scan.FILLER] or list(range(len(want)))
        for at in range(len(heavy) - len(core) + 1):
            places = heavy[at : at + len(core)]
            if [words[p][0] for p in places] != [want[k] for k in core]:
                continue
            edges, ends = [-1, *core, len(want)], [heavy[at - 1] if at else -1, *places, heavy[at + len(core)] if at + len(core) < len(heavy) else len(words)]
            held = len(core) + sum(shared_words(want[a + 1 : b], [w[0] for w in words[c + 1 : d]]) for a, b, c, d in zip(edges, edges[1:], ends, ends[1:], strict=False))
            sentences = any(words[q][0][0].isdigit() and license_scan._STOP.search(text[words[p][2] : words[q][1]]) for p, q in zip(places, places[1:], strict=False))
            if len(want) - held <= 0.25 * len(want) and not (len(core) <= 4 and sentences) and len(want) > 2:
                out.add((name, words[places[0]][1], words[places[-1]][2]))
    return out


def test_licences_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in docs_of(spark, sf).collect()}
    found = Counter()
    for r in QUERIES["op10_licenses"](spark, sf).collect():
        t = text[r["doc_id"]] or ""
        spans = [(n["license"], n["start"], n["end"]) for n in r["notices"]]
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False)) and r["n_notices"] == len(spans) and r["licenses"] == ",".join(sorted({n for n, _, _ in spans}))
        exact = plain_notices(t) if license_scan.CANDIDATE.search(t) else set()
        for name, a, b in exact:
            assert any(x <= a and b <= y for _, x, y in spans if name == _) or any(x < b and a < y for _, x, y in spans if name != _), (r["doc_id"], name)
        for name, x, y in spans:
            assert any(name == n and x <= a and b <= y for n, a, b in exact), (r["doc_id"], name, t[x:y])
            found[name] += 1
    assert sum(found.values()) > 30 and len(found) >= 4


def test_every_template_has_a_licence_word_and_long_texts_take_little_time():
    assert all(license_scan.CANDIDATE.search(t) for _, t in license_scan.TEMPLATES)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    began = time.process_time()
    for t in ("license " * 50_000, "mit license is the " * 20_000, "word " * 100_000 + "Released under the MIT License. " + "word " * 100_000, "MIT License" + " the" * 100_000):
        n, notices = license_scan.scan_text(t, scanner)
        assert n == 1 and ("MIT" not in t or [x["license"] for x in notices] == ["MIT"])
    assert time.process_time() - began < 60


def test_fold_of_null(spark):
    assert spark.createDataFrame([(None,), (1,)], "d bigint").select(in_fold("d", 1, 0)).collect()[0][0] is False
    assert json.loads("[]") == []
