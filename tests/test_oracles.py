"""Every registered query against its independent DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as entry
from fareflow.plans.catalog import QUERIES
from fareflow.plans.oracle_check import digest, duck

from .conftest import SMALL

NAMES = sorted(QUERIES)                     # optional queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql()) and set(NAMES) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "trip_id" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    rows = df.collect()
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, rows) == digest(cols, drows)
