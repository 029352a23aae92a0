"""Queries of the subpackage against their SQL, or that they run."""

import pytest
from oracle import SMALL, rows_of, sql_rows

from graphloom.llm import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got, cols = rows_of(QUERIES[name](spark, SMALL))
    if name in SQL:
        want, names = sql_rows(SQL[name])
        assert cols == names and got == want
