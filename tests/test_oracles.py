"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
