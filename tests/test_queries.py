"""Every registered open-map query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from terralattice import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "tolist") and not hasattr(v, "item"):
        return str(v.tolist())
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(frame):
    columns = sorted(frame.columns)
    out = []
    for r in frame[columns].itertuples(index=False, name=None):
        out.append(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in map(plain, r)))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    mine = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        theirs = db.execute(registry.ORACLES[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine) == rows(theirs)
    else:
        assert len(mine) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
