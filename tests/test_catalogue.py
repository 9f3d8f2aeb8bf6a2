"""Every query of the catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from orograph.plans import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda x: "" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else str(x))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def test_only_triangulation_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"earclip"}


def test_triangles_cover_their_polygons(spark):
    from orograph.plans.regions import _rings

    rings = {r["id"]: r["ring"] for r in _rings(spark, DATA).collect()}
    area = dict.fromkeys(rings, 0.0)
    for t in QUERIES["earclip"](spark, DATA).collect():
        p, q, s = (rings[t["id"]][t[k]] for k in "abc")
        area[t["id"]] += abs((q.x - p.x) * (s.y - p.y) - (s.x - p.x) * (q.y - p.y)) / 2
    for r in QUERIES["polygon_area"](spark, DATA).collect():
        assert abs(area[r["id"]] - r["area"]) < 1e-6


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = plain(QUERIES[name](spark, DATA).toPandas()), plain(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
