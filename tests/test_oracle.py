"""Each query that SQL can express gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest
from conftest import DATA

from codexmill.plans import oracle, queries, storage_queries

QUERIES, SQL = queries.QUERIES | storage_queries.QUERIES, oracle.SQL | storage_queries.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, duck, name):
    rows = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = sorted(rows.columns)
    assert sorted(x[0] for x in found.description) == columns
    at = [[x[0] for x in found.description].index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
