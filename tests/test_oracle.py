"""Registered plans against their SQL twins (DuckDB) at sf0.001."""

import pandas as pd
import pytest

import __spark_entry__ as entry_mod
from conftest import SF001
from lowrank.plans.queries import QUERIES as OWN

SQL = entry_mod.oracle_sql()
QUERIES = entry_mod.queries()


def _norm(df):
    """Rows as text; a null is one value whatever pandas type its column has."""
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else repr(v) for v in row)
                  for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF001).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


def test_every_query_of_the_library_has_sql():
    assert set(OWN) <= set(SQL)


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["j", "p", "w"]
