"""All named queries on the smallest tables, against DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from tripleflow.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
    assert QUERIES.items() <= entry.queries().items()
    assert SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, small, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL[name], small)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["n", "n_items"]
