"""Every core query against its SQL."""

import pytest

from fleetscan.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck, compare):
    compare(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df())


def test_pattern_kinds_of_odd_texts(spark, compare, tmp_path):
    """Hits inside hits, characters of several bytes, line ends and signs that aren't printable, and
    folding outside ASCII, each alone and all together."""
    import duckdb

    texts = ["MIT MIT GPL x, GPL MIT", "a@b@cd@e1 a@abcd9", "MIT.\nLa MIT\n\nli", "MIT\u00e4RL MIT\u20acli MIT\u65e5\u672cL MIT\U0001f600L", "MIT\u00e9LL MIT LL MITLLL", "MIT\u00a0L MIT\u200bli MIT\u00ad\tL", "licen\u017fe LI\u212aENSE li\u212aen\u017fe lickense", "\u4d00\u4900\u5400 \u014d\u4900\u5400\u0100 MIT", "x.\n.\n\n..\n 407@1", "MIT\u65e5\u672c\u8a9eL MIT 12L MITabcl", ""]
    for i, some in enumerate([*([t] for t in texts), texts]):
        (folder := tmp_path / str(i)).mkdir()
        rows = [(k, t, "en", "src0", 1) for k, t in enumerate([*some, None])]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        compare(QUERIES["g2_pattern_kinds"](spark, str(folder)).toPandas(), c.sql(ORACLE_SQL["g2_pattern_kinds"]).df())


@pytest.mark.parametrize(("users", "more"), [(155_000, 0), (3, 2_000_001), (2, 0), (0, 0)])
def test_all_sources_go(spark, compare, tmp_path, users, more):
    """More scans than a list of 100,000 holds, a scan above the default ceiling of rows, and a live
    table of which nothing is left, or that was empty."""
    import duckdb

    rest = "timestamp'2024-01-01' AS ts", "'view' AS event_type", "1.0D AS value", "'1' AS props"
    events = spark.range(users + more).selectExpr("id AS event_id", f"IF(id < {users}, id, 0) AS user_id", *rest)
    events.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    compare(QUERIES["m13_drop_sources"](spark, str(tmp_path)).toPandas(), c.sql(ORACLE_SQL["m13_drop_sources"]).df())


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["rule", "hits"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
