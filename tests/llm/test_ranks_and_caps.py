import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import capping, quantiles, survivor, walk


def test_multi_select_is_exact(spark):
    rng = random.Random(3)
    rows = [("a", rng.choice([-5.0, 0.5, 2.0, rng.random()])) for _ in range(500)] + [(None, float(i)) for i in range(40)] + [("one", 7.0)]
    rows += [("a", None), ("a", float("nan")), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles.pieces(df, ["g"], F.col("v"), parts=20).collect()}
    for g in ("a", None, "one"):
        values = sorted(v for h, v in rows if h == g and v is not None and v == v)
        ranks = quantiles.even_ranks(20)(np.array([len(values)]))[0]
        assert got[g]["n"] == len(values) and got[g]["at"] == [values[r - 1] for r in ranks]
    assert got["inf"]["at"][0] < -1e308 and got["inf"]["at"][-1] > 1e308
    assert quantiles.pieces(df.limit(0), ["g"], F.col("v")).count() == 0


def test_group_blocks_and_bounded_error(spark):
    rows = [(i % 7, float(i * 37 % 1009)) for i in range(1400)]
    df = spark.createDataFrame(rows, "g int, v double")
    exact = {r["g"]: r["at"] for r in quantiles.percentiles(df, ["g"], F.col("v"), quantiles.even_ranks(10)).collect()}
    blocks = {r["g"]: r["at"] for r in quantiles.percentiles(df, ["g"], F.col("v"), quantiles.even_ranks(10), block=2, whole=50).collect()}
    assert exact == blocks
    for whole in (0, 200):  # all by rounds, all inside their task
        assert exact == {r["g"]: r["at"] for r in quantiles.percentiles(df, ["g"], F.col("v"), quantiles.even_ranks(10), block=2, whole=whole).collect()}
    rough = {r["g"]: r["at"] for r in quantiles.percentiles(df, ["g"], F.col("v"), quantiles.even_ranks(10), epsilon=0.05).collect()}
    for g, at in rough.items():
        values = sorted(v for h, v in rows if h == g)
        for r, x in zip(quantiles.even_ranks(10)(np.array([200]))[0], at):
            assert abs(values.index(x) + 1 - r) <= 0.05 * 200 + 1


def test_merged_pieces_bound(spark):
    rng = random.Random(9)
    rows = [(d, rng.gauss(d, 3)) for d in range(6) for _ in range(rng.randrange(50, 400))]
    df = spark.createDataFrame(rows, "day int, v double").withColumn("k", F.lit("x"))
    merged = quantiles.merge_pieces(quantiles.pieces(df, ["k", "day"], F.col("v")), ["k"]).first()
    values = np.sort([v for _, v in rows])
    assert merged["n"] == len(values) and len(merged["at"]) == 101
    for p, x in enumerate(merged["at"]):
        lo, hi = np.searchsorted(values, x, "left") / len(values), np.searchsorted(values, x, "right") / len(values)
        assert lo - 0.025 <= p / 100 <= hi + 0.025


def test_misstated(spark):
    data = spark.createDataFrame([("m", float(i)) for i in range(100)], "g string, v double")
    right = [float(min(99, p)) for p in range(101)]
    wrong = [x + 20 for x in right]
    stats = spark.createDataFrame([(1, "m", right), (2, "m", wrong), (3, "none", right), (4, "m", None), (5, "m", [None] * 101)], "stat_id int, g string, q array<double>")
    assert [r[0] for r in quantiles.misstated(stats, data, ["g"], F.col("v"), "stat_id", "q").collect()] == [2]


def brute_cap(rows, cap, split):
    """(id, owner, stratum, q) rows left out; the same apportionment, one slot at a time where equal."""
    out = set()
    for owner in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == owner]
        sizes = {}
        for r in own:
            sizes[r[2]] = sizes.get(r[2], 0) + 1
        total, slots = len(own), min(cap, len(own))
        if split == "equal":
            quota = dict.fromkeys(sizes, 0)
            while slots:
                open_ = [s for s in sizes if quota[s] < sizes[s]]
                level = min(quota[s] for s in open_)
                low = [s for s in open_ if quota[s] == level]
                for s in sorted(low, key=lambda s: (-sizes[s], s is None, s or ""))[:slots]:
                    quota[s] += 1
                    slots -= 1
        else:
            exact = {s: (cap * n / total if total > cap else n) for s, n in sizes.items()}
            quota = {s: int(x) for s, x in exact.items()}
            rest = slots - sum(quota.values())
            for s in sorted(sizes, key=lambda s: (not sizes[s] > quota[s], -(exact[s] - quota[s]), -sizes[s], s is None, s or ""))[:rest]:
                quota[s] += 1
        for s in sizes:
            ranked = sorted((r for r in own if r[2] == s), key=lambda r: (-(r[3] if r[3] is not None else float("-inf")), r[0]))
            out |= {r[0] for r in ranked[quota[s]:]}
    return out


def test_caps_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "x", "y", "z", None]), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, owner string, stratum string, q double").withColumn("_g", F.lit(1)).withColumn("n", F.lit("clash"))
    for split in ("proportional", "equal"):
        for cap in (0, 7, 40, 1000):
            got = {r["id"] for r in capping.beyond_cap(df, "id", ["owner"], F.col("q"), cap, ["stratum"], split, salts=4).collect()}
            assert got == brute_cap(rows, cap, split), (split, cap)
            sized = {r["id"] for r in capping.beyond_cap(df, "id", ["owner"], F.col("q"), cap, ["stratum"], split).collect()}
            assert sized == got
    plain = {r["id"] for r in capping.beyond_cap(df, "id", ["owner", "stratum"], F.col("q"), 8).collect()}
    assert plain == brute_cap([(i, (o, s), "", q) for i, o, s, q in rows], 8, "proportional")
    assert capping.beyond_cap(df.limit(0), "id", ["owner"], F.col("q"), 8).count() == 0


def test_walk_first_step_is_mid_rank(spark):
    rng = random.Random(2)
    rows = [(i, *[rng.choice([None, 0.0, 1.0, 5.0, rng.random() * 9]) for _ in range(3)]) for i in range(80)] + [(99, None, None, float("nan"))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: r["mass"] for r in walk.rank_walk(df, "id", ["a", "b", "c"], steps=1, damping=1.0).collect()}
    for i, *values in rows:
        pos = []
        for j, v in enumerate(values):
            own = [r[j + 1] for r in rows if r[j + 1] is not None and r[j + 1] == r[j + 1]]
            if v is not None and v == v:
                pos.append((sum(x < v for x in own) + sum(x <= v for x in own)) / len(own) / 2)
        assert (i in got) == bool(pos)
        if pos:
            assert abs(got[i] - 2 * sum(pos) / len(pos)) < 1e-9


def test_walk_settles_and_ignores_scale(spark):
    rows = [(i, float(i), float(i * i * 1000)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = [r["id"] for r in walk.rank_walk(df, "id", ["a", "b"], steps=6).orderBy(F.col("mass").desc()).collect()]
    assert got == list(range(29, -1, -1))
    assert walk.rank_walk(df.limit(0), "id", ["a", "b"], steps=2).count() == 0


def test_survivors_nulls_and_ties(spark):
    rows = [("h", 1, None, "MIT"), ("h", 2, 5.0, ""), ("h", 2, 5.0, ""), ("h", 3, 5.0, None), ("solo", 4, 1.0, "MIT"), ("solo", 4, 1.0, "MIT"), (None, 5, 1.0, "x"), ("", 6, 1.0, "x"), ("n", 7, None, None), ("n", 8, None, None)]
    df = spark.createDataFrame(rows, "h string, id int, s double, l string")
    fields = {"keep": ([F.col("s"), -F.col("id")], None), "lic": ([-F.col("id")], F.coalesce(F.col("l") != "", F.lit(False)))}
    got = {r["h"]: (r["keep"], r["lic"]) for r in survivor.survivors(df, "h", "id", fields).collect()}
    assert got == {"h": (2, 1), "n": (7, 0)}


def test_consensus(spark):
    rows = [("g", "the quick brown fox", 1.0), ("g", "the quick brown dog", 1.0), ("g", "the quick red fox", 1.0), ("g", None, 9.0), ("one", "x", None), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v string, w double")
    assert {r["g"]: r["v"] for r in survivor.consensus(df, "g", "v", F.col("w"), "v").collect()} == {"g": "the quick brown fox", "one": "x"}
    many = spark.createDataFrame([("g", f"name number {i % 90}", 1.0) for i in range(400)], "g string, v string, w double")
    assert survivor.consensus(many, "g", "v", F.col("w"), "v", block=16).count() == 1
