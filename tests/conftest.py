import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _plain(v):
    if pd.isna(v) if v is None or pd.api.types.is_scalar(v) else False:
        return "null"
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    try:
        f = float(v)
        return str(int(f)) if f == int(f) else repr(f)
    except (TypeError, ValueError):
        return str(v)


def rows(pdf, columns):
    """Rows as sorted strings, so that engines compare."""
    return sorted("|".join(map(_plain, r)) for r in pdf[columns].astype(object).values.tolist())


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL on the small tables."""

    def check(run, sql):
        got, want = run(spark, SMALL).toPandas(), duck.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)

    return check
