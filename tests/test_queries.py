"""Every registered query with SQL, compared on the smallest data set."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_sql_has_a_query():
    assert not set(ORACLE) - set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
