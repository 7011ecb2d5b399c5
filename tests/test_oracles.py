"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

from silthouse.plans import registry
from silthouse.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:10] if not isinstance(x, datetime.datetime) or x.time() == datetime.time() else str(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_says_what_its_sql_says(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
