"""Every registered query of the colour operators runs, and equals its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from huelake.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def same(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(n for n in plans.QUERIES if not n.endswith("_all_cells")))  # test_whole_tables.py runs those
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    made = sorted(([same(r[c]) for c in columns] for r in df.collect()), key=str)
    assert made
    if name in plans.ORACLES:
        r = duck.sql(plans.ORACLES[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert made == sorted(([same(x[i]) for i in at] for x in r.fetchall()), key=str)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
