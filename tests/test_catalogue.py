"""Every catalogue query with SQL against that SQL, on the smallest tables that fill it."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

from tarnvol.plans import catalogue

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, float):
        return "null" if math.isnan(v) else round(v, 5) + 0.0
    return "null" if v is None else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    rows = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rs: sorted(map(str, rs))
    assert key(tuple(map(_plain, r)) for r in rows.fetchall()) == key(tuple(_plain(r[c]) for c in names) for r in got.collect())


def test_names_are_registered():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
