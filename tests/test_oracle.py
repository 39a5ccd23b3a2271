"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from varlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted((tuple(plain(None if pd.isna(v) else v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["ml_scoreall", "ml_pretrain", "gr_leiden", "flt_doublet", "gr_umap"])
def test_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
