"""Every query with a DuckDB oracle, compared value by value on the smallest tables; the others run."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from windrow.plans.catalog import QUERIES
from windrow.plans.oracles import ORACLES

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return round(float(x), 9) + 0.0 if isinstance(x, (int, float, np.number)) else x


def rows(df, cols):
    return sorted(repr(tuple(map(plain, r))) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 1
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
