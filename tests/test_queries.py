"""Each registered query runs and agrees with its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lamella import catalogue


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(values):
    return sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in columns]).collect())
    if name in catalogue.ORACLES:
        want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        assert got == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
