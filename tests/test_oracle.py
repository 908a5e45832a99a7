"""Every query with an SQL text gives the same rows as DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, con, name):
    ok, text = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
