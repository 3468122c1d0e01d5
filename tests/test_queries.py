"""Every core query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from foliospark import queries as core

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted(repr([clean(r[c]) for c in cols]) for r in df.collect())
    if name in core.oracle_sql():
        res = con.execute(core.oracle_sql()[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted(repr([clean(r[names.index(c)]) for c in cols]) for r in res.fetchall())
        assert got == want


def test_entry_lists_everything(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
