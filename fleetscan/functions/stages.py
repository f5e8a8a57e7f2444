"""Query stages and scalar functions with the meaning that the panels rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(col: str | Column, text: str, case_sensitive: bool = True) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.contains(text) if case_sensitive else F.lower(c).contains(text.lower())


def to_float(col: str | Column) -> Column:
    """Number of a text, null where it is none."""
    return (F.col(col) if isinstance(col, str) else col).try_cast("double")


def to_integer(col: str | Column) -> Column:
    """Whole number towards zero, null where it is none."""
    return to_float(col).cast("bigint")


def to_text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def divide(a: Column, b: Column) -> Column:
    """Float division; null by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def from_millis(col: str) -> Column:
    return F.timestamp_millis(to_integer(col))


def bin_millis(col: str, width_ms: int) -> Column:
    """Start of the bucket that a millisecond stamp falls in."""
    return F.col(col) - F.pmod(F.col(col), F.lit(width_ms))


def bin_time(col: str, span: str) -> Column:
    """Start of the tumbling window, UTC."""
    return F.window(F.col(col), span)["start"]


def dedup_latest(df: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """The row with the largest ``order`` of each key; ties by further columns, largest first."""
    place = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in (order, *ties)))
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def dedup_any(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def latest(col: str, order: str, *ties: str) -> Column:
    """Aggregate: the value in the row with the largest order."""
    return F.max_by(F.col(col), F.struct(order, *ties) if ties else F.col(order))


def value_set(col: str) -> Column:
    return F.collect_set(col)


def expand(df: DataFrame, col: str, name: str) -> DataFrame:
    """One row for each element; none for null and empty arrays."""
    return df.withColumn(name, F.explode(col))


def json_array(col: str, element: str) -> Column:
    return F.from_json(F.col(col), f"array<{element}>")


def json_scalar(col: str, path: str) -> Column:
    """A JSON value as text; null where the path is missing."""
    return F.get_json_object(F.col(col), path)


def top(df: DataFrame, n: int, by: str, *keys: str) -> DataFrame:
    """The n rows with the largest ``by``; ties in the order of the keys."""
    return df.orderBy(F.col(by).desc_nulls_last(), *(F.col(k).asc_nulls_first() for k in keys)).limit(n)
