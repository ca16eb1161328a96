import random

import numpy as np
import pytest

import __spark_entry__ as entry
from corpusmill.llm import queries, walk
from corpusmill.operators.latest import latest
from corpusmill.runtime import table


def at_rest(rows, damping):
    """Mass of (key, values...) rows where the walk stands still, by solving its equations."""
    values = np.array([[np.nan if v is None else float(v) for v in r[1:]] for r in rows])
    n = len(rows)
    step, known = np.zeros((n, n)), ~np.isnan(values)
    for c in range(values.shape[1]):
        at = np.where(known[:, c])[0]
        v = values[at, c]
        lower = (v[:, None] > v[None, :]) + 0.5 * (v[:, None] == v[None, :])
        chain = lower / len(at)
        chain[np.diag_indices(len(at))] += lower.sum(axis=1) / len(at)
        step[np.ix_(at, at)] += chain
    some = known.any(axis=1)
    step = step[np.ix_(some, some)] / known[some].sum(axis=1)[:, None]
    mass = np.linalg.solve(np.eye(len(step)) - damping * step, np.full(len(step), 1 - damping))
    return {r[0]: m for r, m in zip([r for r, s in zip(rows, some) if s], mass)}


def test_walk_comes_to_rest(spark):
    rng = random.Random(8)
    rows = [(i, *[rng.choice([None, 0.0, 3.0, rng.random() * 9]) for _ in range(3)]) for i in range(200)] + [(999, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: r["mass"] for r in walk.rank_walk(df, "id", ["a", "b", "c"], tolerance=1e-6).collect()}
    want = at_rest(rows, 0.85)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5
    with pytest.raises(ValueError):
        walk.rank_walk(df, "id", ["a"], damping=1.0)


def test_query_is_at_rest(spark, data):
    repos = latest(table(spark, data, "repos"), "full_name", "last_meta_at", queries.REPO_SCORES)
    want = at_rest([tuple(r) for r in repos.select("full_name", *queries.REPO_SCORES).collect()], 0.85)
    got = {r["full_name"]: r["mass"] for r in entry.queries()["p5_rank_walk"](spark, data).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_hot_values_are_salted(spark):
    rng = random.Random(5)
    rows = [(i, 0.0 if i % 3 else rng.random(), float(rng.randrange(3))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    want = at_rest(rows, 0.85)
    got = {r["id"]: r["mass"] for r in walk.rank_walk(df, "id", ["a", "b"], tolerance=1e-6, hot_rows=20).collect()}
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_first_share_takes_whole_order(spark):
    df = spark.createDataFrame([(f"k{i:03d}", float(i % 7)) for i in range(100)], "k string, v double")
    want = [r[0] for r in sorted(((f"k{i:03d}", i % 7) for i in range(100)), key=lambda r: (-r[1], r[0]))][:33]
    assert sorted(r["k"] for r in walk.first_share(df, "k", "v", 33).collect()) == sorted(want)
