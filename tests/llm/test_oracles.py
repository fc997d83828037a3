"""The queries that have DuckDB SQL give its rows and column names."""

import os

import duckdb
import pytest

from basalt.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, sf, name):
    df, want = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[c] for c in columns) for r in rows)


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))
