"""Every query of the problems tagged llm on the smallest tables."""

import pytest
from conftest import DATA, rows
from memloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.SQL:
        assert rows(got) == rows(duck.execute(queries.SQL[name]).df())
    else:
        assert len(got.columns) > 0
