"""Every registered query against its SQL form; those without one must return rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_as_sql(spark, con, sf_dir, key):
    assert compare(QUERIES[key](spark, sf_dir), con, ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
