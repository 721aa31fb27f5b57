"""Every registered query against its SQL on the smallest tables (tests/check.py does the same at any scale)."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from hushline.catalog.registry import QUERIES

SF = "/root/testdata/sf0.001"
entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 150
    assert entry.entry(spark).columns[:2] == ["machine_type", "section"]


WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql is not None)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, duck, name):
    ok, message = compare(spark, duck, QUERIES[name], SF)
    assert ok, message
