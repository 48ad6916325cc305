"""Every registered query against its SQL at the smallest size."""

import math
import os

import duckdb
import pytest

from skylattice.plans import catalog, reports  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    return v if isinstance(v, (int, bool)) or v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["hour_bucket", "flight_count", "avg_altitude_ft", "avg_speed_kmh"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
