"""Every registered query of the dialect against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from skein.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def normal(rows):
    return sorted((tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", catalogue.queries())
def test_against_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert normal(got.select(*order).collect()) == normal(want.select(*[f'"{c}"' for c in order]).fetchall())


def test_entry(spark):
    assert catalogue.entry(spark, DATA).count() > 0
