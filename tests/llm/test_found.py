"""The pN_ queries against brute force and SQL on the smallest tables."""

import os

import duckdb
import pytest

import compare
from corpusmill.llm import queries as q


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, data, con, name):
    df = q.queries()[name](spark, data)
    got = compare.rows_of(df.columns, df.collect())
    cur = con.execute(q.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == compare.rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, data, name):
    rows = q.queries()[name](spark, data).count()
    assert rows > 0 or name == "p6_by_category"  # no repo is over that cap in the smallest tables
