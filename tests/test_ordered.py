"""Order within a key, by blocks, against the plain form."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscan.operators import ordered
from fleetscan.operators.telemetry import performance_metrics, resource_trends, throttle_reports

BEGIN = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def snapshots(spark):
    rnd = random.Random(3)
    times = rnd.sample(range(100_000), 900)
    rows = [(None if i % 50 == 7 else f"h{i % 3 if i % 2 else 0}", BEGIN + datetime.timedelta(seconds=t), str(rnd.randint(0, 99)), "x" if i % 31 == 0 else str(rnd.randint(0, 99)), str(rnd.randint(1, 50)), None) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "hostname string, _time timestamp, sys_cpu_percent string, sys_memory_used_percent string, proc_cpu_percent string, proc_memory_mb string")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_numbers_without_gaps(spark):
    rows = [(k, v % 7) for k in (None, "a", "b") for v in range(40)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {}
    for r in ordered.numbered(df.repartition(5), ["k"], ["v"], "n").collect():
        got.setdefault(r["k"], []).append((r["n"], r["v"]))
    assert {k: [n for n, _ in sorted(v)] for k, v in got.items()} == {k: list(range(40)) for k in (None, "a", "b")}
    assert all([x for _, x in sorted(v)] == sorted(x for _, x in v) for v in got.values())
    assert ordered.numbered(df.limit(0), ["k"], ["v"], "n").count() == 0


def test_trends_and_peaks_by_blocks_equal_whole_windows(snapshots):
    recent = Window.partitionBy("hostname").orderBy("_time").rowsBetween(-9, 0)
    v = F.col("sys_cpu_percent").try_cast("double")
    n = F.count("*").over(recent)
    plain = snapshots.select("hostname", "_time", F.when(n >= 2, F.round(F.avg(v).over(recent), 6)).alias("cpu_avg"), F.when(n >= 2, n).otherwise(F.lit(0)).alias("data_points"))
    assert rows_of(resource_trends(snapshots, 10, 16).select("hostname", "_time", "cpu_avg", "data_points")) == rows_of(plain)
    assert rows_of(resource_trends(snapshots, 10, 16)) == rows_of(resource_trends(snapshots, 10))
    so_far = Window.partitionBy("hostname").orderBy("_time").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("proc_cpu_percent").try_cast("double")
    plain = snapshots.select("hostname", "_time", F.max(v).over(so_far).alias("peak_cpu"), F.round(F.avg(v).over(so_far), 6).alias("avg_cpu"), F.lit(None).cast("double").alias("avg_memory_mb"))
    assert rows_of(performance_metrics(snapshots, 16).select("hostname", "_time", "peak_cpu", "avg_cpu", "avg_memory_mb")) == rows_of(plain)
    assert performance_metrics(snapshots, 16).columns == [*snapshots.columns, "peak_cpu", "avg_cpu", "peak_memory_mb", "avg_memory_mb"]


def test_no_window_over_a_whole_host(snapshots):
    for df in (resource_trends(snapshots), performance_metrics(snapshots)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all("__block" in line or "__least" in line or "__n#" in line or "_max" in line for line in plan.split("\n") if "Window [" in line)


def plain_kept(rows, least):
    out, last = [], {}
    for host, worker, t in sorted(rows, key=lambda r: r[2]):
        if (host, worker) not in last or (t - last[host, worker]).total_seconds() >= least:
            last[host, worker] = t
            out.append((host, worker, t))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [4, 50, 1 << 16])
def test_hot_workers_are_throttled_by_blocks(spark, hot):
    rnd = random.Random(hot)
    rows = [("h", "w1", BEGIN + datetime.timedelta(seconds=rnd.randint(0, 900))) for _ in range(400)] + [("h", None, BEGIN + datetime.timedelta(seconds=i)) for i in range(0, 300, 3)]
    rows += [("h2", "w1", BEGIN + datetime.timedelta(seconds=i)) for i in range(3)] + [(None, "w", BEGIN)] * 60
    rows = [r for i, r in enumerate(rows) if r[2] not in {x[2] for x in rows[:i] if x[:2] == r[:2]}]
    df = spark.createDataFrame([*rows, ("h", "w1", None)], "hostname string, worker_id string, _time timestamp").repartition(3)
    for least in (1, 10, 30, 5000):
        assert sorted(str((r["hostname"], r["worker_id"], r["_time"])) for r in throttle_reports(df, least, hot).collect()) == plain_kept(rows, least)
    assert throttle_reports(df, 0).count() == len(rows)


def test_a_way_through_many_blocks(spark):
    rnd = random.Random(8)
    steps, want = [], set()
    for k, n in (("a", 700), ("b", 1), ("c", 63)):
        follows = [min(i + rnd.randint(1, 40), n) for i in range(n)]
        follows = [x if x < n else ordered.END for x in follows]
        steps += [(k, i, x) for i, x in enumerate(follows)]
        at = 0
        while at < ordered.END:
            want.add((k, at))
            at = follows[at]
    df = spark.createDataFrame(steps, "k string, node long, next long").repartition(4)
    for block in (3, 16, 1024):
        got = [tuple(r) for r in ordered.chain(df, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
