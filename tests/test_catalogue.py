"""Every registered query with a DuckDB form is held against it on the smallest tables."""

import datetime
import math
from collections import Counter
from pathlib import Path

import pytest

from tidewell.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are absent")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 7) + 0.0
    return str(v)[:19].replace(" 00:00:00", "") if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    wanted = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in sorted(wanted.columns)]
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql_is_repeatable(spark, name):
    a, b = (sorted(map(str, catalogue.QUERIES[name](spark, str(DATA)).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["trade_date", "n", "ic"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
