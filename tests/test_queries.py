"""Every query of the library's own operators against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from keyline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
