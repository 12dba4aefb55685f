"""Every query of the core against its SQL on the smallest tables."""

import pytest
from conftest import DATA, rows
from memloom.plans import catalogue, hygiene, wider

QUERIES = {**hygiene.QUERIES, **catalogue.QUERIES, **wider.QUERIES}
SQL = {**hygiene.SQL, **catalogue.SQL, **wider.SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
