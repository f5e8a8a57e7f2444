import pytest
from pyspark.sql import functions as F

from fleetscan.operators import maintenance as m
from fleetscan.operators.telemetry import throttle_reports
from fleetscan.schemas import FINDINGS, LIFECYCLE, conform
from fleetscan.sources import tables

NOW = 1_800_000_000_000
HOUR = 3_600_000


def names(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "name string")


def test_names(spark):
    df = names(spark, "sigscan_matches_v2_winhost01_ab12cd_202608", "sigscan_scans_v2_linux7_ff00aa_202608", "sigscan_matches_v2_scan_abc123x", "sigscan_matches_v2", "other", "sigscan_matches_v4_h1_aabbcc")
    got = {r["name"]: (r["kind"], r["version"], r["host"], r["month"]) for r in m.parse_shard(df).collect()}
    assert got == {"sigscan_matches_v2_winhost01_ab12cd_202608": ("matches", 2, "winhost01_ab12cd", "202608"), "sigscan_scans_v2_linux7_ff00aa_202608": ("scans", 2, "linux7_ff00aa", "202608")}
    flags = {r["name"]: (r["scan_target"], r["overwrite"]) for r in m.parse_names(df).collect()}
    assert flags["sigscan_matches_v2_scan_abc123x"] == (True, False) and flags["sigscan_matches_v4_h1_aabbcc"] == (False, True)


@pytest.mark.parametrize(
    ("status", "age", "acted", "want"),
    [("running", 10 * HOUR, "ABORTED", None), ("running", HOUR, None, "host_not_terminal"), ("running", 25 * HOUR, None, None), ("completed", HOUR // 6, None, "within_quiet_period"), ("completed", HOUR, None, None)],
)
def test_gate(spark, status, age, acted, want):
    life = spark.createDataFrame([("s", "h", status, NOW - age)], "scan_id string, hostname string, status string, event_timestamp_ms bigint")
    actions = spark.createDataFrame([("s", "h", acted)] if acted else [], "scan_id string, hostname string, state string")
    stats = spark.createDataFrame([("t", "s", "h", NOW - age, None)], "shard string, scan_id string, hostname string, newest_endpoint_ms bigint, newest_ingest_ms bigint")
    assert m.gate(stats, m.terminal_map(life, actions), NOW).first()["reason"] == want


@pytest.mark.parametrize(("ep", "srv", "want"), [(NOW - 9 * HOUR, NOW, NOW), (NOW + HOUR, NOW, NOW), (NOW, NOW * 1000, NOW), (None, NOW + HOUR, NOW + HOUR), (None, None, None)])
def test_newest(spark, ep, srv, want):
    df = spark.createDataFrame([(ep, srv)], "ep bigint, srv bigint")
    assert df.select(m.newest_ms(F.col("ep"), F.col("srv"), NOW)).first()[0] == want


def test_stamps(spark):
    df = spark.createDataFrame([(x,) for x in ("1799999995000", "1799999995000.0", "1.8e12", "2027-01-15T08:00:00Z", "true", "x", None)], "c string")
    got = [r[0] for r in df.select(m.as_ms("c")).collect()]
    assert got[:3] == [1799999995000, 1799999995000, 1800000000000] and got[3] == 1800000000000 and got[4:] == [None] * 3


def test_plan_and_reverify(spark):
    df = spark.createDataFrame([("a", 7, 7), ("b", 7, 6), ("c", 2_000_001, 0), ("d", 0, 0)], "scan_id string, source_rows bigint, target_rows bigint")
    assert [r["state"] for r in m.plan(df).orderBy("scan_id").collect()] == ["verified", "count_mismatch", "row_ceiling_exceeded", "count_mismatch"]
    again = spark.createDataFrame([("a", 7, 0), ("b", 7, 7), ("c", 3, 7), ("d", 7, 3)], "scan_id string, source_rows bigint, target_rows bigint")
    assert [r["state"] for r in m.reverify(again).orderBy("scan_id").collect()] == ["write", "verified", "verified", "count_mismatch"]


def test_compact_keeps_every_row(spark, tmp_path):
    rows = [(f"s{i % 6}", f"h{i % 3}", f"/f{i}") for i in range(60)]
    shards = {h: spark.createDataFrame([r for r in rows if r[1] == h], "scan_id string, hostname string, filename string") for h in ("h0", "h1", "h2")}
    ids = spark.createDataFrame([(f"s{i}",) for i in range(6)], "scan_id string")
    to = str(tmp_path / "target")
    dry = m.compact(spark, shards, to, ids)
    assert dry.planned == ["s0", "s1", "s2", "s3"] and dry.stopped_early and not (tmp_path / "target").exists()
    done = m.compact(spark, shards, to, ids, dry_run=False)
    assert done.verified == ["s0", "s1", "s2", "s3"] and not done.failed
    assert m.compact(spark, shards, to, ids, max_scans=9, dry_run=False).verified == [f"s{i}" for i in range(6)]
    assert {(r["scan_id"], r["hostname"], r["filename"]) for r in spark.read.parquet(to).collect()} == set(rows)
    assert m.compact(spark, shards, to, ids, max_scans=9, dry_run=False).planned == []


def test_small_scans_share_files(spark, tmp_path):
    rows = spark.range(120).selectExpr("concat('0', id % 40) AS scan_id", "'h' AS hostname", "concat('/f', id) AS filename")
    to, ids = str(tmp_path / "target"), rows.select("scan_id").distinct().unionByName(spark.createDataFrame([(None,)], "scan_id string"))
    done = m.compact(spark, {"h": rows}, to, ids, max_scans=50, dry_run=False)
    assert len(done.verified) == 40 and not done.failed and not done.stopped_early
    assert len(list((tmp_path / "target").rglob("*.parquet"))) <= 4 and spark.read.parquet(to).count() == 120
    again = m.compact(spark, {"h": rows}, to, ids, max_scans=50, dry_run=False)
    assert again.verified == done.verified and not again.planned and spark.read.parquet(to).count() == 120


def test_a_pass_of_all_scans(spark, tmp_path):
    rows = spark.range(121).selectExpr("concat('s', if(id < 100, id % 20, 20)) AS scan_id", "concat('h', id % 2) AS hostname", "concat('/f', id) AS filename")
    shards, to, ids = {h: rows.where(F.col("hostname") == h) for h in ("h0", "h1")}, str(tmp_path / "target"), rows.where("scan_id <> 's7'").select("scan_id")
    some = m.compact(spark, shards, to, ids, max_scans=None, dry_run=False, ceiling=20)
    assert len(some.planned) == 19 and some.verified == some.planned and some.failed == {"s20": "row_ceiling_exceeded"} and not some.stopped_early
    rest = m.compact(spark, shards, to, ids, max_scans=None, dry_run=False, ceiling=None)
    assert rest.planned == ["s20"] and len(rest.verified) == 20 and not rest.failed
    assert sorted(map(tuple, spark.read.parquet(to).select(*rows.columns).collect())) == sorted(map(tuple, rows.where("scan_id <> 's7'").collect()))
    dry = m.compact(spark, shards, to, ids, max_scans=None)
    assert dry.planned == [] and dry.verified == rest.verified and dry.dry_run


def test_rows_go_by_a_table_of_keys(spark, tmp_path):
    to = str(tmp_path / "live")
    spark.createDataFrame([("s1", "h1"), ("s2", "h1"), (None, "h2"), ("s1", "h3")], "scan_id string, hostname string").write.partitionBy("hostname").parquet(to)
    keys = spark.createDataFrame([("s1",), ("s9",), (None,)], "scan_id string")
    assert tables.delete_rows(spark, to, keys, "hostname") == 2
    assert {(r["scan_id"], r["hostname"]) for r in spark.read.parquet(to).collect()} == {("s2", "h1"), (None, "h2")}


def test_droppable_needs_every_scan(spark):
    s = spark.createDataFrame([("sigscan_matches_v2_a_aaaaaa_202601", "x"), ("sigscan_matches_v2_a_aaaaaa_202601", "y"), ("sigscan_matches_v2_b_bbbbbb_202601", "x"), ("sigscan_matches_v4_c_cccccc", "x")], "shard string, scan_id string")
    assert [r[0] for r in m.droppable(s, spark.createDataFrame([("x",)], "scan_id string")).collect()] == ["sigscan_matches_v2_b_bbbbbb_202601"]


def test_retention_rails(spark):
    df = names(spark, "sigscan_matches_v3_a_aaaaaa_202601", "sigscan_matches_v3_a_aaaaaa_202607", "sigscan_matches_v3_a_aaaaaa_202608", "sigscan_matches_v3_a_aaaaaa_202609", "sigscan_matches_v4_a_aaaaaa", "sigscan_scans_v3_a_aaaaaa", "sigscan_matches_v3_scan_1", "x")
    got = {r["name"][-6:]: r["reason"] for r in m.select_rotated(df, 6, 2026, 8).collect()}
    assert got["202601"] is None and got["202607"] == "within_window" and got["202608"] == "current_month" and got["202609"] == "future_month"
    legacy = m.select_legacy(df, 2, 0, 2026, 8)
    assert legacy.where("selected").count() == 0
    none = m.prune(df.withColumn("newest_endpoint_ms", F.lit(0).cast("bigint")).withColumn("newest_ingest_ms", F.lit(None).cast("bigint")), NOW, 2026, 8)
    assert none.where("selected").count() == 0
    gone = []
    stamped = df.withColumn("newest_endpoint_ms", F.lit(0).cast("bigint")).withColumn("newest_ingest_ms", F.lit(None).cast("bigint"))
    m.prune(stamped, NOW, 2026, 8, months=6, execute=True, drop=gone.append)
    assert gone == ["sigscan_matches_v3_a_aaaaaa_202601"]


def test_tables(spark, tmp_path):
    to = str(tmp_path / "f")
    df = conform(spark.createDataFrame([("s1", "h1", "/a"), ("s1", "h2", "/b")], "scan_id string, hostname string, filename string"), FINDINGS)
    tables.overwrite_host_findings(df, to)
    tables.overwrite_host_findings(df.where("hostname = 'h1'").withColumn("scan_id", F.lit("s2")), to)
    assert {(r["scan_id"], r["hostname"]) for r in spark.read.parquet(to).collect()} == {("s2", "h1"), ("s1", "h2")}
    assert tables.delete_rows(spark, to, F.col("scan_id") == "s2", "hostname") == 1
    assert [r["hostname"] for r in spark.read.parquet(to).collect()] == ["h2"]
    life = conform(spark.createDataFrame([("s", 1_700_000_000_000)], "scan_id string, event_timestamp_ms bigint"), LIFECYCLE)
    tables.append_lifecycle(life, str(tmp_path / "l"))
    tables.append_lifecycle(life, str(tmp_path / "l"))
    assert [r["month"] for r in spark.read.parquet(str(tmp_path / "l")).collect()] == [202311, 202311]
    tables.append_compaction_run(spark, str(tmp_path / "r"), "crashed", error="x" * 900)
    assert len(spark.read.parquet(str(tmp_path / "r")).first()["error_message"]) == 500
    tables.append_cleanup_run(spark, str(tmp_path / "c"), "success", True, None, 24, ["t" * 5000], 0, {})
    row = spark.read.parquet(str(tmp_path / "c")).first()
    assert row["rotated_months"] == -1 and len(row["deleted"]) == 4000
    with pytest.raises(ValueError, match="unknown"):
        conform(df.withColumn("odd", F.lit(1)), FINDINGS)


def test_deletes_in_odd_partitions(spark, tmp_path):
    to = str(tmp_path / "d")
    hosts = ["a:b", "x/y", "k=v", "sp ace", "50%", "007", None, "ok"]
    spark.createDataFrame([(h, i, h) for h in hosts for i in range(4)], "hostname string, n int, was string").write.partitionBy("hostname").parquet(to)
    gone = F.col("n").isin(1, 2) | F.col("was").isin("k=v", "x/y") | F.col("was").isNull()
    assert tables.delete_rows(spark, to, gone, "hostname") == 2 * 5 + 4 * 3
    left = spark.read.parquet(to).collect()
    assert sorted((r["was"], r["n"]) for r in left) == sorted((h, n) for h in ("a:b", "sp ace", "50%", "007", "ok") for n in (0, 3)) and all(str(r["hostname"]).lstrip("0") == r["was"].lstrip("0") for r in left)
    assert tables.delete_rows(spark, to, F.col("n") == 9, "hostname") == 0 and not list(tmp_path.glob("d__*"))
    # A call that ended before the folders were touched is finished by the next.
    tables_finish, tables._finish_delete = tables._finish_delete, lambda *a: None
    try:
        with pytest.raises(RuntimeError):
            tables.delete_rows(spark, to, F.col("was") == "ok", "hostname")
    finally:
        tables._finish_delete = tables_finish
    assert tables.delete_rows(spark, to, F.col("n") == 9, "hostname") == 0
    assert sorted({r["was"] for r in spark.read.parquet(to).collect()}) == ["007", "50%", "a:b", "sp ace"] and not list(tmp_path.glob("d__*"))


def test_a_clean_rescan_empties_the_host(spark, tmp_path):
    to = str(tmp_path / "f")
    df = conform(spark.createDataFrame([("s1", "h:1", "/a"), ("s1", "h2", "/b"), ("s1", "h3", "/c")], "scan_id string, hostname string, filename string"), FINDINGS)
    tables.overwrite_host_findings(df, to)
    tables.overwrite_host_findings(df.where("hostname = 'h2'").withColumn("scan_id", F.lit("s2")), to, ["h:1", "h2", "none"])
    assert {(r["scan_id"], r["hostname"]) for r in spark.read.parquet(to).collect()} == {("s2", "h2"), ("s1", "h3")}


def test_coerce_loses_nothing(spark):
    df = spark.createDataFrame([("0", "9.0", "7.5", " TRUE ", "x"), ("9.25", "9007199254740993", "q", "no", None)], "a string, b string, c string, d string, e string")
    got = [r.asDict() for r in m.coerce(df, {"a": "number", "b": "integer", "c": "integer", "d": "bool", "e": "number", "f": "text"}).collect()]
    assert got == [{"a": 0.0, "b": 9, "c": None, "d": True, "e": None, "f": None, "unparsed": {"c": "7.5", "e": "x"}}, {"a": 9.25, "b": 9007199254740993, "c": None, "d": False, "e": None, "f": None, "unparsed": {"c": "q"}}]


def test_sources_go_after_verification(spark, tmp_path):
    a, b, live = "sigscan_matches_v3_a_aaaaaa_202601", "sigscan_matches_v3_b_bbbbbb_202601", str(tmp_path / "live")
    rows = {a: [("s1", "h1", 1), ("s1", "h1", 2)], b: [("s1", "h2", 3), ("s2", "h2", 4)]}
    paths = {n: str(tmp_path / n) for n in rows}
    for n, r in rows.items():
        spark.createDataFrame(r, "scan_id string, hostname string, match_total bigint").write.parquet(paths[n])
    spark.createDataFrame([("s1", "h1", 9), ("s2", "h1", 9)], "scan_id string, hostname string, n int").write.partitionBy("hostname").parquet(live)
    shards = {n: spark.read.parquet(p) for n, p in paths.items()}
    scans = spark.createDataFrame([(n, i) for n, r in rows.items() for i in {x[0] for x in r}], "shard string, scan_id string")
    ids = spark.createDataFrame([("s1",)], "scan_id string")
    dry = m.compact(spark, shards, str(tmp_path / "t"), ids)
    assert m.drop_sources(spark, paths, scans, dry, (live,)) == ([], 0)
    done = m.compact(spark, shards, str(tmp_path / "t"), ids, dry_run=False)
    assert done.verified == ["s1"] and m.drop_sources(spark, paths, scans, done, (live,)) == ([a], 1)
    assert not (tmp_path / a).exists() and (tmp_path / b).exists() and [r["scan_id"] for r in spark.read.parquet(live).collect()] == ["s2"]


def test_throttling_counts_from_the_last_kept(spark):
    rows = [("h", w, f"2024-01-01 00:0{s // 60}:{s % 60:02d}", s) for w in ("a", "b") for s in (29, 30, 59, 60, 88, 89)] + [("h", None, "2024-01-01 00:00:00", 0), ("h", "a", None, -1)]
    df = spark.createDataFrame(rows, "hostname string, worker_id string, at string, n int").withColumn("_time", F.col("at").cast("timestamp"))
    got = throttle_reports(df, 30)
    assert got.columns == df.columns and sorted((str(r["worker_id"]), r["n"]) for r in got.collect()) == [("None", 0), ("a", 29), ("a", 59), ("a", 89), ("b", 29), ("b", 59), ("b", 89)]
    assert throttle_reports(df, 0).count() == 13


def test_union_of_versions_and_summary(spark):
    old = spark.createDataFrame([("s", "h", "/a", "r1", 3, 5)], "scan_id string, hostname string, filename string, rule string, match_count bigint, event_timestamp_ms bigint")
    both = tables.read_union([old, conform(old.limit(0), FINDINGS)])
    assert [tuple(r) for r in m.scan_rule_summary(both).collect()] == [("s", "h", "r1", 5)]


def test_ruleset(spark, tmp_path):
    p = tmp_path / "pack.json"
    p.write_text('{"rule":"a","strings":[{"id":"$a","pattern":"x"}],"condition":"true"}\n{"rule":"b","strings":[{"id":"$a","pattern":""}],"condition":"true"}\n{"rule":"a","condition":"true"}\n')
    assert sorted(r["status"] for r in tables.load_ruleset(spark, str(p)).collect()) == ["failed", "skipped", "valid"]
    p.write_text("")
    with pytest.raises(ValueError, match="no rule"):
        tables.load_ruleset(spark, str(p))


def test_corpus_and_telemetry_files(spark, tmp_path):
    for n, body in {"a/x.txt": b"ab", "a/b/y.bin": b"\x00" * 9, "c/z": b""}.items():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(body)
    roots = [str(tmp_path / "a"), str(tmp_path / "c")]
    rows = {r["path"].rsplit("/", 1)[1]: r["file_size"] for r in tables.read_corpus(spark, roots, "h").collect()}
    assert rows == {"x.txt": 2, "y.bin": 9}
    assert tables.read_corpus(spark, roots, "h", max_bytes=5).count() == 1
    table = tables.corpus_from_table(spark.createDataFrame([("h", "/p", "\u00e9")], "a string, b string, c string"), "a", "b", "c")
    assert table.first()["file_size"] == 2
    (tmp_path / "t.json").write_text('{"type":"x","hostname":"h","_time":"2024-01-01T00:00:00Z"}\n[1]\nbroken\n')
    got = tables.read_telemetry(spark, str(tmp_path / "t.json")).cache()
    assert got.where("_corrupt_record is null").count() == 1 and got.where("_corrupt_record is not null").count() == 2
    tables.write_telemetry(got.where("_corrupt_record is null").drop("_corrupt_record"), str(tmp_path / "out"))
    assert tables.read_telemetry(spark, str(tmp_path / "out")).first()["type"] == "x"
    tables.write_alerts(got.select("type"), str(tmp_path / "al"))
    assert spark.read.parquet(str(tmp_path / "al")).count() == 3
