"""The meaning of query stages and scalar functions."""

from pyspark.sql import functions as F

from fleetscan.functions import stages as s


def one(df, *cols):
    return tuple(df.select(*cols).first())


def test_numbers(spark):
    df = spark.createDataFrame([("12.9", "-3.7", "x", None, "0")], "a string, b string, c string, d string, z string")
    assert one(df, s.to_integer("a"), s.to_integer("b"), s.to_integer("c"), s.to_integer("d")) == (12, -3, None, None)
    assert one(df, s.to_float("a"), s.divide(s.to_float("a"), s.to_float("z")), s.divide(F.lit(7), F.lit(2)), s.to_text(F.lit(5))) == (12.9, None, 3.5, "5")


def test_text_and_json(spark):
    df = spark.createDataFrame([("Worker Thread", '{"a":{"b":[7,8]},"t":true}', '["x","y"]', None)], "m string, j string, l string, n string")
    assert one(df, s.contains("m", "worker"), s.contains("m", "worker", False), F.concat("m", "n")) == (False, True, None)
    assert one(df, s.json_scalar("j", "$.a.b[0]"), s.json_scalar("j", "$.t"), s.json_scalar("j", "$.q"), s.json_array("l", "string")) == ("7", "true", None, ["x", "y"])


def test_time(spark):
    df = spark.createDataFrame([(7_199_999, -1)], "ms bigint, early bigint")
    assert one(df, s.bin_millis("ms", 3_600_000), s.bin_millis("early", 1000)) == (3_600_000, -1000)
    assert str(one(df, s.from_millis("ms"))[0]) == "1970-01-01 01:59:59.999000"
    t = df.select(F.lit("2024-01-01 00:17:00").cast("timestamp").alias("_time"))
    assert str(one(t, s.bin_time("_time", "10 minutes"))[0]) == "2024-01-01 00:10:00"


def test_rows(spark):
    df = spark.createDataFrame([("a", 1, "x", [1, 2]), ("a", 2, "y", []), ("b", 1, "z", None), ("b", 1, "w", [3])], "k string, t int, v string, l array<int>")
    assert {(r["k"], r["v"]) for r in s.dedup_latest(df, ["k"], "t", "v").collect()} == {("a", "y"), ("b", "z")}
    assert s.dedup_any(df, ["k"]).count() == 2
    assert sorted(r["e"] for r in s.expand(df, "l", "e").collect()) == [1, 2, 3]
    assert {r["k"]: r["v"] for r in df.groupBy("k").agg(s.latest("v", "t", "v").alias("v")).collect()} == {"a": "y", "b": "z"}
    assert {r["k"]: sorted(r["s"]) for r in df.groupBy("k").agg(s.value_set("v").alias("s")).collect()} == {"a": ["x", "y"], "b": ["w", "z"]}
    assert [r["v"] for r in s.top(df, 3, "t", "v").collect()] == ["y", "w", "x"]
