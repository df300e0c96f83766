"""Every query over the smallest tables against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert df.columns
        return
    result = duck.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert len(catalogue.QUERIES) == sum(len(m.QUERIES) for m in catalogue.MODULES)  # no name twice

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
