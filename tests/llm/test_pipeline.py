"""The corpus pipeline, stage by stage, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetscan.llm import decontam, quality, tokens
from fleetscan.llm.common import in_fold, materialize
from tests.llm.test_operators import check_packing, plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, sf_dir), "t")
    return [*out, docs]


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5]) and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(stages, spark, sf_dir):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"), ~in_fold("doc_id", 5, 0))
    want = {r["doc_id"] for r in quality.scored(stages[0], model).where(F.col("score") >= 0.3).collect()}
    assert set(rows(stages[1])) == want and 0 < len(want) < stages[0].count()


def test_near_dedup_stage(stages):
    docs = sorted(rows(stages[1]).items())
    comp = plain_components([plain_fingerprint(t) for _, t in docs])
    assert rows(stages[2]) == {docs[i][0]: docs[i][1] for i in set(comp)}


def test_decontamination_stage(stages, spark, sf_dir):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = decontam.words_of(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = {}
    for i, t in rows(stages[2]).items():
        w = decontam.words_of(t)
        if not any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1)):
            clean[i] = t
    assert rows(stages[3]) == clean and len(clean) < stages[2].count()


def test_pii_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after) and any(before[i] != after[i] for i in before)
    for i, t in before.items():
        for m in re.findall(r"[A-Za-z0-9.]+@[a-z0-9]+\.example\.com|[0-9a-f]{40}|\+1 \(\d{3}\) \d{3}-\d{4}", t):
            assert m not in after[i]
        if not re.search(r"\d|@", t):
            assert after[i] == t
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_stage(stages):
    check_packing(stages[5].collect(), list(rows(stages[4]).items()))
    assert tokens.default_tokenizer().endswith(".json")


def test_odd_documents(spark, sf_dir):
    df = spark.createDataFrame([(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "x y", None, None, None), (2, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("pii", F.lit("kept")).withColumn("score", F.lit(1))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, sf_dir), "t")
        assert docs.columns == df.columns
    assert {r["pii"] for r in docs.collect()} <= {"kept"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf_dir).count() == 0
