"""Every query of the core against the SQL another engine runs on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from engram.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None or not isinstance(x, (list, dict, bytes)) and pd.isna(x):
        return None
    if isinstance(x, float):
        return str(int(x)) if math.isfinite(x) and x == int(x) else repr(float(x))
    return str(bool(x)) if type(x).__name__ in ("bool", "bool_") else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(cell(x) for x in r) for r in df.itertuples(index=False)), key=lambda r: tuple("" if v is None else v for v in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    got = registry.queries()[name](spark, SF)
    assert len(got.toPandas().columns) == len(got.schema.names) > 0


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
