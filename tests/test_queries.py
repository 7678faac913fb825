"""Every query on the smallest data: runs, keeps its columns, and equals its SQL twin."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from symloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")
#: Every query of the core that has a twin.
NAMES = sorted(registry.oracles())


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set threads to 4")
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = entry.queries()[name](spark, str(DATA))
    r = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall()), key=repr)
    got = sorted((tuple(plain(x[c]) for c in sorted(columns)) for x in df.collect()), key=repr)
    assert got == want


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["node", "depth"] and df.count() >= 0
