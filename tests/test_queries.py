"""Every query that has SQL gives what its SQL gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import compare
from corpusmill.plans import queries as core


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql(spark, data, con, name):
    df = core.queries()[name](spark, data)
    got = compare.rows_of(df.columns, df.collect())
    cur = con.execute(core.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == compare.rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, data, name):
    assert core.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_parse_round_trip(spark, data):
    got = {r["id"]: r for r in core.queries()["text_parse"](spark, data).collect()}
    want = core.skills(spark, data, "name", "description", "body").collect()
    for r in want:
        assert got[r["id"]]["name"] == (r["name"] or "").strip()
        assert got[r["id"]]["description"] == (r["description"] or "").strip()
        assert got[r["id"]]["body_len"] == len((r["body"] or "").strip())
