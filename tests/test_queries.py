"""Every registered query that has SQL gives DuckDB's rows and types on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from basalt.plans.catalog import ORACLE, QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def bag(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert sorted(df.columns) == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes if t in TYPES} == {c: types[c] for c, t in df.dtypes if t in TYPES}
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert bag(df.collect(), sorted(df.columns)) == bag(rows, sorted(df.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
