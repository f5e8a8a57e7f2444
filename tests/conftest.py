import os

import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    b = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
    s = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same_rows(got, want):
    """Equal columns, and equal rows in any order, compared as text."""
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)

    def plain(df):
        out = df[cols].copy()
        for c in cols:
            if out[c].dtype.kind in "fi":
                out[c] = out[c].astype(float)
        return out.astype(str).replace({"None": "", "nan": "", "NaT": "", "<NA>": ""}).sort_values(cols).reset_index(drop=True)

    a, b = plain(want), plain(got)
    assert len(a) == len(b)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(5).to_string()


@pytest.fixture(scope="session")
def compare():
    return same_rows
