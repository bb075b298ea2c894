"""Registered corpus queries against their DuckDB texts on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from requestmarts.llm import queries

from tests.test_oracle import canonical

ORACLES = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    df = queries.queries()[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert rows == canonical(columns, result.fetchall())
    assert rows
