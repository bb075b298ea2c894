"""Every registered query against its DuckDB text on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("orders", "customer", "nation", "region")
QUERIES, ORACLES = entry.request_queries(), entry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows in a fixed order, columns by name; numbers, dates and texts stay apart."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert rows == canonical(columns, result.fetchall())
    assert rows
