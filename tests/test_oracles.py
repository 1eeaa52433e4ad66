"""Every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from kitwright.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return x


def rows(table, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in table), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sql, name):
    got = QUERIES[name](spark, SF)
    want = sql.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), columns)
