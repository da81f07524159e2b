"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from racelab.plans import registry

SF = "/root/testdata/sf0.001"
#: Every query that has SQL.
SAMPLE = sorted(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiub":
            df[c] = df[c].astype(float).round(6)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, con, name):
    got, want = plain(registry.QUERIES[name](spark, SF).toPandas()), plain(con.sql(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            same = [(a == b) or (pd.isna(a) and pd.isna(b)) for a, b in zip(got[c], want[c])]
            assert all(same), c


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
