"""Every query of the core against its SQL, or at least to its end."""

import pytest
from oracle import connect, same

from graphloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        df.collect()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
