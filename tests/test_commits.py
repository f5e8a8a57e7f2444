"""Many writers of one table at once, and readers of its versions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from fleetscan.sources import commits

DDL = "hostname string, n bigint"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def rows_of(df):
    return sorted(((r["hostname"] or "", r["n"]) for r in df.collect()))


def test_eight_writers_lose_nothing(spark, tmp_path):
    table = str(tmp_path / "t")

    def writer(k):
        for i in range(3):
            commits.append(frame(spark, (f"h{k}", 10 * k + i), ("shared", 100 * k + i)), table, "hostname")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(writer, range(8)))
    want = [(f"h{k}", 10 * k + i) for k in range(8) for i in range(3)] + [("shared", 100 * k + i) for k in range(8) for i in range(3)]
    assert rows_of(commits.read(spark, table, "hostname")) == sorted(want)
    assert sorted(r["version"] for r in commits.log(spark, table).collect()) == list(range(24))


def test_replacing_and_deleting_at_once(spark, tmp_path):
    table = str(tmp_path / "t")
    for k in range(4):
        commits.append(frame(spark, *((f"h{k}", i) for i in range(10))), table, "hostname")

    def change(k):
        if k < 4:
            return commits.replace(frame(spark, (f"h{k}", 50 + k), (f"h{k}", 3)), table, "hostname")
        return commits.delete(spark, table, "hostname", F.col("n") < 5)

    with ThreadPoolExecutor(5) as pool:
        list(pool.map(change, range(5)))
    got = rows_of(commits.read(spark, table, "hostname"))
    # Each host has its second version; its small row went if the deletion came after it.
    assert [r for r in got if r[1] >= 50] == [(f"h{k}", 50 + k) for k in range(4)] and {r[1] for r in got if r[1] < 50} <= {3}
    assert commits.delete(spark, table, "hostname", F.col("n") < 5) == sum(r[1] == 3 for r in got)
    assert rows_of(commits.read(spark, table, "hostname")) == [(f"h{k}", 50 + k) for k in range(4)]
    assert commits.delete(spark, table, "hostname", F.col("n") < 5) == 0


def test_readers_see_one_version(spark, tmp_path):
    table = str(tmp_path / "t")
    commits.append(frame(spark, ("a", 1), ("b", 2), (None, 3)), table, "hostname")
    commits.replace(frame(spark, ("a", 9)), table, "hostname", ["b"])
    commits.append(frame(spark, ("x/y=z %", 4)), table, "hostname")
    commits.delete(spark, table, "hostname", F.col("hostname").isNull())
    assert [rows_of(commits.read(spark, table, "hostname", v)) for v in (1, 2, 3, 4)] == [[("", 3), ("a", 1), ("b", 2)], [("", 3), ("a", 9)], [("", 3), ("a", 9), ("x/y=z %", 4)], [("a", 9), ("x/y=z %", 4)]]
    assert rows_of(commits.read(spark, table, "hostname")) == [("a", 9), ("x/y=z %", 4)]
    gone = commits.vacuum(spark, table, keep=1)
    assert len(gone) == 2 and rows_of(commits.read(spark, table, "hostname")) == [("a", 9), ("x/y=z %", 4)]


def test_an_unfinished_commit_is_not_read(spark, tmp_path):
    table = str(tmp_path / "t")
    commits.append(frame(spark, ("a", 1)), table, "hostname")
    commits._write(frame(spark, ("a", 2)), table, "hostname")
    assert rows_of(commits.read(spark, table, "hostname")) == [("a", 1)] and commits.vacuum(spark, table) == []
    assert not commits._create(spark, f"{table}/log/{0:012d}.json", "{}") and commits.log(spark, table).count() == 1


def test_empty_and_conflicting_changes(spark, tmp_path):
    table = str(tmp_path / "t")
    assert commits.log(spark, table).count() == 0
    commits.append(frame(spark, ("a", 1)), table, "hostname")
    commits.append(frame(spark, ("a", 1)).limit(0), table, "hostname")
    commits.replace(frame(spark, ("a", 1)).limit(0), table, "hostname", ["a"])
    assert rows_of(commits.read(spark, table, "hostname")) == []
    with pytest.raises(commits.Conflict):
        commits._enter(spark, table, "c", frame(spark).schema, [], lambda v: [("c", str(v))], 0)
