"""Every core query with SQL against DuckDB, and every other one for rows, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from cohortlake.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert a == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["pca_loadings", "folds", "rank_fallback", "region_masks"])
def test_query_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
