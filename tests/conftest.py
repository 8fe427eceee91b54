"""One local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(sf):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return db


def rows_of(frame):
    """Sorted rows as tuples of plain values, columns by name; whole floats equal integers."""
    import pandas as pd

    def plain(v):
        if v is None or pd.isna(v):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
            return str(int(v))
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))
