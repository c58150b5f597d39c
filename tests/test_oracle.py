"""Every query of the library against its SQL in DuckDB, over whole tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from lethewise.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "none"
    return v


def rows(df):
    made = (tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    return sorted(made, key=lambda r: [repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert list(got.columns) == list(dict.fromkeys(got.columns))
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            for u, v in zip(x, y, strict=True):
                assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-6 * max(1, abs(v)))
    else:
        assert len(got)
