"""Every query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    ours = queries()[name](spark, SF).toArrow()
    theirs = con.sql(SQL[name]).to_arrow_table()
    assert difference(ours, theirs) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0
