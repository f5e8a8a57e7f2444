import json
import os

import pytest
from pyspark.sql import functions as F

from fleetscan.operators.scan import Pattern, Rule, of_them
from fleetscan.streaming import jobs


def drain(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name).collect()


def write_json(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # a stream takes the oldest file first


def test_ingest(spark, tmp_path):
    write_json(tmp_path / "in", 1, [{"type": "yara_match", "hostname": "h", "data": '{"rule":"r","match_count":2}', "_time": "2024-01-01T00:00:00Z"}, {"type": "other", "hostname": "h"}])
    q = jobs.ingest_telemetry(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(300)
    rows = {r["type"]: r["rule_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"yara_match": "r", "other": None}


def stream(spark, path, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(path))


def test_tumbling_and_first(spark, tmp_path):
    ddl = "scan_id string, hostname string, rule string, path string, n bigint, _time timestamp"
    row = {"scan_id": "s", "hostname": "h", "rule": "r", "path": "/a", "n": 2}
    write_json(tmp_path / "in", 1, [row | {"_time": "2024-01-01T00:01:00Z"}, row | {"_time": "2024-01-01T00:02:00Z"}])
    write_json(tmp_path / "in", 2, [row | {"_time": "2024-01-01T03:00:00Z", "path": "/b"}])
    got = drain(jobs.tumbling(stream(spark, tmp_path / "in", ddl), "5 minutes", ["hostname"], [F.sum("n").alias("n")]), spark, "tumbling", tmp_path)
    assert [r["n"] for r in got][:1] == [4]
    first = drain(jobs.first_findings(stream(spark, tmp_path / "in", ddl)), spark, "firsts", tmp_path)
    assert sorted(r["path"] for r in first) == ["/a", "/b"]


def test_upsert_takes_event_time(spark, tmp_path):
    ddl = "scan_id string, status string, event_timestamp_ms bigint"
    write_json(tmp_path / "in", 1, [{"scan_id": "s", "status": "completed", "event_timestamp_ms": 9}])
    write_json(tmp_path / "in", 2, [{"scan_id": "s", "status": "initiated", "event_timestamp_ms": 1}])
    q = stream(spark, tmp_path / "in", ddl).writeStream.foreachBatch(jobs.upsert_latest(str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert [r["status"] for r in jobs.read_latest(spark, str(tmp_path / "t")).collect()] == ["completed"]


def test_upsert_is_idempotent_and_loses_nothing(spark, tmp_path):
    table, ddl = str(tmp_path / "t"), "scan_id string, status string, event_timestamp_ms bigint"
    up = jobs.upsert_latest(table, buckets=4)
    batch = lambda *rows: spark.createDataFrame(list(rows), ddl)
    up(batch(*((f"s{i}", "running", 1) for i in range(20))), 0)
    up(batch(("s1", "completed", 5), ("s2", "failed", 0)), 1)
    up(batch(("s1", "completed", 5), ("s2", "failed", 0)), 1)
    got = {r["scan_id"]: r["status"] for r in jobs.read_latest(spark, table).collect()}
    assert len(got) == 20 and got["s1"] == "completed" and got["s2"] == "running"
    with pytest.raises(ValueError, match="status"):
        up(batch(("s1", "x", 9)).drop("status"), 2)
    # A version is missing: rows of other buckets and of earlier versions still count.
    for v in range(3, 9):
        up(batch((f"s{v}", f"v{v}", 10 + v)), v)
    got = {r["scan_id"]: r["status"] for r in jobs.read_latest(spark, table).collect()}
    assert len(got) == 20 and [got[f"s{v}"] for v in range(3, 9)] == [f"v{v}" for v in range(3, 9)] and got["s1"] == "completed"
    assert len(jobs.folders_of(spark, table)) < 8


def test_scan_of_a_batch_that_is_tried_again(spark, tmp_path):
    rules = [Rule("R", (Pattern("R", "$a", "x"),), of_them(["$a"]), "low")]
    batch = spark.createDataFrame([("s", "h", "linux", "/a", "xx", 1)], "scan_id string, hostname string, os_type string, path string, content string, event_timestamp_ms bigint")
    for _ in range(2):
        jobs.scan_new_files(rules, str(tmp_path / "out"))(batch, 3)
    assert [(r["filename"], r["match_total"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("/a", 2, 3)]


def test_stateful_processors(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl = "scan_id string, rule string, path string, _time timestamp"
    write_json(tmp_path / "in", 1, [{"scan_id": "s", "rule": f"r{i % 2}", "path": f"/{i}", "_time": "2024-01-01T00:00:00Z"} for i in range(5)])
    write_json(tmp_path / "in", 2, [{"scan_id": "t", "rule": "r", "path": "/x", "_time": "2024-01-01T05:00:00Z"}])
    write_json(tmp_path / "in", 3, [{"scan_id": "t", "rule": "r", "path": "/y", "_time": "2024-01-01T06:00:00Z"}])
    got = drain(jobs.cap_stream(stream(spark, tmp_path / "in", ddl), cap=2), spark, "capped", tmp_path)
    assert sum(r["n"] for r in got if r["scan_id"] == "s") == 5
    assert sorted((r["rule"], r["n"]) for r in got if r["kind"] == "rollup" and r["scan_id"] == "s") == [("r0", 2), ("r1", 1)]

    ddl = "scan_id string, status string, event_timestamp_ms bigint"
    write_json(tmp_path / "life", 1, [{"scan_id": "a", "status": "running", "event_timestamp_ms": 1_700_000_000_000}, {"scan_id": "b", "status": "completed", "event_timestamp_ms": 1_700_000_000_000}])
    write_json(tmp_path / "life", 2, [{"scan_id": "c", "status": "completed", "event_timestamp_ms": 1_700_090_000_000}])
    write_json(tmp_path / "life", 3, [{"scan_id": "c", "status": "completed", "event_timestamp_ms": 1_700_099_000_000}])
    stale = drain(jobs.stale_scans(stream(spark, tmp_path / "life", ddl)), spark, "stale", tmp_path)
    assert [(r["scan_id"], r["status"]) for r in stale] == [("a", "running")]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "spark.sql.streaming.stateStore.providerClass"


def test_a_scan_of_very_many_alerts_is_capped_in_parts(spark, tmp_path):
    spark.conf.set(STATE, ROCKS)
    ddl = "scan_id string, rule string, path string, _time timestamp"
    at = lambda i: f"2024-01-01T00:{i % 8:02d}:{i % 60:02d}Z"
    for f in range(3):
        write_json(tmp_path / "in", f, [{"scan_id": "s", "rule": f"r{i % 3}", "path": f"/{f}/{i}", "_time": at(i)} for i in range(2000)])
    write_json(tmp_path / "in", 8, [{"scan_id": "t", "rule": "r", "path": "/x", "_time": "2024-01-01T05:00:00Z"}])
    write_json(tmp_path / "in", 9, [{"scan_id": "t", "rule": "r", "path": "/y", "_time": "2024-01-01T06:00:00Z"}])
    for parts in (1, 4):
        source = stream(spark, tmp_path / "in", ddl)
        got = [r for r in drain(jobs.cap_stream(source, cap=50, parts=parts), spark, f"parts{parts}", tmp_path) if r["scan_id"] == "s"]
        alerts = [r for r in got if r["kind"] == "alert"]
        held = {r["rule"]: r["n"] for r in got if r["kind"] == "rollup"}
        assert len(alerts) == 50 and len({r["path"] for r in alerts}) == 50 and sum(held.values()) == 6000 - 50
        sent = {k: sum(r["rule"] == k for r in alerts) for k in held}
        assert {k: held[k] + sent[k] for k in held} == {f"r{i}": 3 * len(range(i, 2000, 3)) for i in range(3)}
    # A batch's first alerts in order of time, path and rule, whatever their part.
    first = sorted((at(i), f"/0/{i}") for i in range(2000))[:50]
    assert all(r["path"].count("/") == 2 for r in alerts) and ({r["path"] for r in alerts} == {p for _, p in first} or len({r["path"][:3] for r in alerts}) == 1)


def test_findings_seen_are_bounded(spark, tmp_path):
    spark.conf.set(STATE, ROCKS)
    ddl = "scan_id string, hostname string, rule string, path string, _time timestamp"
    row = lambda i, rule="r": {"scan_id": "s", "hostname": "h", "rule": rule, "path": f"/{i}", "_time": f"2024-01-01T00:00:{i % 60:02d}Z"}
    write_json(tmp_path / "in", 0, [row(i) for i in range(40)] * 2 + [row(1, None)])
    write_json(tmp_path / "in", 1, [row(i) for i in range(30, 60)] + [row(1, None)])
    write_json(tmp_path / "in", 2, [row(59), row(0)])
    whole = drain(jobs.first_findings_bounded(stream(spark, tmp_path / "in", ddl)), spark, "seen", tmp_path)
    assert len(whole) == 61 and len({(r["rule"], r["path"]) for r in whole}) == 61
    # Ten ids: what was forgotten comes again, what is recent doesn't, and nothing is lost.
    few = [(r["rule"], r["path"]) for r in drain(jobs.first_findings_bounded(stream(spark, tmp_path / "in", ddl), most=10, parts=1), spark, "few", tmp_path)]
    assert set(few) == {(r["rule"], r["path"]) for r in whole} and few.count(("r", "/0")) == 2 and few.count(("r", "/59")) == 1


def test_reports_are_throttled_over_batches(spark, tmp_path):
    spark.conf.set(STATE, ROCKS)
    ddl = "hostname string, worker_id string, _time timestamp"
    row = lambda s, w="w": {"hostname": "h", "worker_id": w, "_time": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"}
    write_json(tmp_path / "in", 0, [row(s) for s in (40, 0, 10, 29, 31)] + [row(5, None)])
    write_json(tmp_path / "in", 1, [row(s) for s in (59, 60, 61, 20, 90)] + [row(34, None), row(35, None)])
    got = drain(jobs.throttle_stream(stream(spark, tmp_path / "in", ddl), 30), spark, "throttled", tmp_path)
    assert sorted((r["worker_id"] or "", r["_time"].minute * 60 + r["_time"].second) for r in got) == [("", 5), ("", 35), ("w", 0), ("w", 31), ("w", 61)]


def test_keys_share_states(spark, tmp_path):
    """Many keys in one state: calls to the state store don't grow with the keys."""
    spark.conf.set(STATE, ROCKS)
    ddl = "scan_id string, hostname string, rule string, path string, _time timestamp"
    row = lambda i, hour, scan: {"scan_id": scan, "hostname": "h", "rule": "r", "path": f"/{i}", "_time": f"2024-01-01T{hour:02d}:00:00Z"}
    write_json(tmp_path / "in", 0, [row(i % 3, 0, f"s{i // 3}" if i // 3 else None) for i in range(1800)])
    write_json(tmp_path / "in", 1, [row(i % 4, 1, f"s{i // 4}" if i // 4 else None) for i in range(2400)])
    write_json(tmp_path / "in", 2, [row(0, 9, "late")])
    write_json(tmp_path / "in", 3, [row(0, 9, "late")])
    write_json(tmp_path / "in", 4, [row(0, 9, "s5"), row(0, 9, "late")])
    q = jobs.first_findings_bounded(stream(spark, tmp_path / "in", ddl)).writeStream.format("memory").queryName("shared").option("checkpointLocation", str(tmp_path / "shared")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = [(r["scan_id"], r["path"]) for r in spark.table("shared").collect()]
    # Those of a scan that was silent are forgotten, and come again.
    assert len(got) == 2400 + 2 and got.count(("s5", "/0")) == 2 and got.count((None, "/3")) == 1
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 4 * jobs.STATES


def test_capped_scans_share_states(spark, tmp_path):
    spark.conf.set(STATE, ROCKS)
    ddl = "scan_id string, rule string, path string, _time timestamp"
    at = lambda hour: f"2024-01-01T{hour:02d}:00:00Z"
    write_json(tmp_path / "in", 0, [{"scan_id": f"s{i // 4}", "rule": None if i % 4 == 3 else "r", "path": f"/{i % 4}", "_time": at(0)} for i in range(2400)])
    for f in (1, 2, 3):
        write_json(tmp_path / "in", f, [{"scan_id": "s0", "rule": "r", "path": "/x", "_time": at(2 * f)}])
    q = jobs.cap_stream(stream(spark, tmp_path / "in", ddl), cap=2).writeStream.format("memory").queryName("sharing").option("checkpointLocation", str(tmp_path / "sharing")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.table("sharing").collect()
    assert sum(r["kind"] == "alert" for r in got) == 2 * 600
    told = {(r["scan_id"], r["rule"]): r["n"] for r in got if r["kind"] == "rollup" and r["scan_id"] != "s0"}
    assert len(told) == 2 * 599 and set(told.values()) == {1}
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= 4 * jobs.STATES


def test_stale_scans_share_states(spark, tmp_path):
    spark.conf.set(STATE, ROCKS)
    ddl, ms = "scan_id string, status string, event_timestamp_ms bigint", 1_700_000_000_000
    write_json(tmp_path / "in", 0, [{"scan_id": f"s{i % 900}", "status": "running" if i < 900 or i % 3 else "failed", "event_timestamp_ms": ms + i} for i in range(1800)])
    write_json(tmp_path / "in", 1, [{"scan_id": "s1", "status": "completed", "event_timestamp_ms": ms + 5}, {"scan_id": "s2", "status": "completed", "event_timestamp_ms": ms + 5000}])
    for f in (2, 3):
        write_json(tmp_path / "in", f, [{"scan_id": "now", "status": "running", "event_timestamp_ms": ms + f * 90_000_000}])
    q = jobs.stale_scans(stream(spark, tmp_path / "in", ddl)).writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "silent")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {r["scan_id"]: (r["status"], r["last_ms"]) for r in spark.table("silent").collect()}
    assert got == {f"s{i}": ("running", ms + 900 + i) for i in range(900) if i % 3 and i != 2}
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 4 * jobs.STATES


def test_a_large_table_streams_in_as_many_batches_of_more_files(spark):
    from fleetscan import table_queries as q

    seen = []
    rows = spark.range(0, 800, 1, 8)
    q._each_batch(spark, q._stream(spark, rows, per_batch=1), lambda b, _: seen.append((b.count(), b.select(F.input_file_name()).distinct().count())))
    assert len(seen) == 3 and sum(n for n, _ in seen) == 800
    assert max(files for _, files in seen) == 3  # no task gets a batch whole
