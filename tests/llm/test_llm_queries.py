import pytest
from oracle import connect, same

from graphloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    if name in queries.SQL:
        same(df, connect(small), queries.SQL[name])
    else:
        df.collect()
