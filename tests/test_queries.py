"""Every query against its DuckDB oracle on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from tallyweave.plans import catalog
from tallyweave.plans.base import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 9) if not isinstance(x, str | bool | int) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(cell(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(catalog.ORACLES[name])
    theirs = [c[0] for c in answer.description]
    assert sorted(theirs) == columns
    want = [tuple(cell(r[theirs.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
