"""One Spark session for all tests, and a DuckDB connection over the same tables."""

from __future__ import annotations

import glob
import math
import os
import sys
from pathlib import Path

import pandas as pd
import pytest

REPO = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (REPO, os.environ.get("PYTHONPATH", "")) if p)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, str) or isinstance(x, bool):
        return str(x)
    return str(round(float(x), 6)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


@pytest.fixture(scope="session")
def rows_of():
    """Columns in order and rows as sorted tuples of text, for comparing two engines."""

    def rows(frame):
        columns = sorted(frame.columns)
        return columns, sorted(tuple(_plain(x) or "" for x in r) for r in frame[columns].astype(object).itertuples(index=False))

    return rows
