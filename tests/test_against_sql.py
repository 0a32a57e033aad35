"""Every registered query against its SQL, on the smallest test tables."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driver_queries.oracle_side import ORACLE  # noqa: E402
from driver_queries.spark_side import QUERIES  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def rows_of(frame):
    ordered = frame[sorted(frame.columns)]
    rows = [tuple(plain(v) for v in row) for row in ordered.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


# Its SQL would have to write Spark's JSON text; test_insights checks the hash.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"insight_context_hash"}))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, FOLDER).toPandas()
    assert name in ORACLE, "a query without SQL is not checked"
    expected = duck.execute(ORACLE[name]).df()
    assert sorted(result.columns) == sorted(expected.columns)
    assert rows_of(result) == rows_of(expected)
