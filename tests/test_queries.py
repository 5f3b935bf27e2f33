"""Every query of the engine's own catalogue against its SQL in DuckDB, on the smallest tables."""

import pytest

from quantweft.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, same, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    out = QUERIES[name](spark, DATA)
    assert out.columns
    out.toPandas()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
