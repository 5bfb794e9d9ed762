import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    """A pandas frame as sorted rows, columns by name, doubles rounded."""
    columns = sorted(frame.columns)

    def value(v):
        if v is None or v != v:
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr(round(v, 6)) if isinstance(v, float) else str(list(v) if isinstance(v, (list, tuple)) else v)

    return columns, sorted(tuple(value(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))
