"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from tallyloom.plans import registry
from tallyloom.plans.adapter import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def spelled(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return str([spelled(v) for v in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert got.count() >= 0
        return
    want = con.execute(registry.oracle_sql()[name])
    have, names = [d[0] for d in want.description], sorted(got.columns)
    assert sorted(have) == names
    rows = sorted(tuple(spelled(r[have.index(n)]) for n in names) for r in want.fetchall())
    assert sorted(tuple(spelled(v) for v in r) for r in got.select(*names).collect()) == rows


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
