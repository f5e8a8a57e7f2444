"""A session with the settings that the jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, app: str = "fleetscan", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides with dots as ``__``."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
