"""Every ledger query against its SQL in DuckDB on the smallest given tables."""

import os

import duckdb
import pytest

from tallywright.plans import queries, streams

SF = "/root/testdata/sf0.001"
ALL = queries.QUERIES | streams.QUERIES
SQL = queries.ORACLES | streams.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        path = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table[n].to_pylist() for n in names], strict=True)))


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    assert rows(ALL[name](spark, SF).toArrow()) == rows(duck.sql(SQL[name]).to_arrow_table())
