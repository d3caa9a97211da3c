"""Every query with SQL against DuckDB, on the smallest data."""

import pytest

import __spark_entry__ as entry
from checks.registry import ORACLES, QUERIES
from checks.compare import connect, differences

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = [d for d in differences(duck, df, ORACLES[name]) if d != "no rows"]
    assert not found


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 14
