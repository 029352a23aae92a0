"""Every core query agrees with its SQL, or at least runs with a stable schema, over the smallest tables."""

import pytest
from oracle import SMALL, rows_of, sql_rows

from graphloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_agrees_with_sql(spark, name):
    got, cols = rows_of(QUERIES[name](spark, SMALL))
    want, names = sql_rows(SQL[name])
    assert cols == names
    assert got == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()
