"""Every named query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from candlewright import catalog

SLOW = {"signals_all_bars", "scan_latest", "gate_rejections", "gate_top5", "walk_forward_deals", "walk_forward_stats"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    ours, theirs = normal(catalog.queries()[name](spark, sf).toPandas()), normal(duck.sql(catalog.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
    for c in ours.columns:
        if ours[c].dtype.kind in "fiu":
            assert np.allclose(ours[c].astype(float), theirs[c].astype(float), atol=1e-12, rtol=1e-12, equal_nan=True), c
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c


def test_entry_has_rows(spark, sf):
    assert catalog.entry(spark, sf).count() > 0
