import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.llm import queries, survivor


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def by_place(votes):
    """The value closest to the heaviest token of each place, for values of equal length."""
    split = {v: v.split() for v in votes}
    wanted = []
    for i in range(len(next(iter(split.values())))):
        count = defaultdict(float)
        for v, w in votes.items():
            count[split[v][i]] += w
        wanted.append(max(count, key=count.get))
    return min(votes, key=lambda v: (edits(split[v], wanted), -votes[v], v))


def test_groups_beyond_a_block_lose_no_value_or_vote(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(6):
        base = [f"w{g}x{i}" for i in range(7)]
        votes = {}
        for k in range(300 if g else 20):
            own = list(base)
            for i in rng.sample(range(7), 1 if k == 17 else rng.choice([2, 3])):
                own[i] = f"odd{rng.randrange(10**6)}"
            votes[" ".join(own)] = 1.0 if k == 17 else float(rng.choice([1, 2, 3]))
        rows += [(g, v, w) for v, w in votes.items()]
        want[g] = by_place(votes)
    df = spark.createDataFrame(rows, "g int, v string, w double")
    for block in (64, 16):
        got = {r["g"]: r["v"] for r in survivor.consensus(df, "g", "v", F.col("w"), "v", block=block).collect()}
        assert got == want, block


def test_tokens_after_the_first_200_count(spark):
    start = " ".join(f"t{i}" for i in range(300))
    rows = [("g", start + " right end", 1.0), ("g", start + " right end too", 1.0), ("g", start + " wrong stop", 1.5)]
    df = spark.createDataFrame(rows, "g string, v string, w double")
    assert survivor.consensus(df, "g", "v", F.col("w"), "v").first()["v"] == start + " right end"


def test_values_without_tokens_keep_their_votes(spark):
    df = spark.createDataFrame([("g", "", 5.0), ("g", "a b", 1.0), ("g", "a c", 1.0)], "g string, v string, w double")
    assert survivor.consensus(df, "g", "v", F.col("w"), "v").first()["v"] == ""


@pytest.fixture(scope="module")
def chosen(spark, data):
    return entry.queries()["p3_consensus"](spark, data).collect()


def test_query_decides_fields_that_differ(spark, data, chosen):
    import math

    votes = defaultdict(lambda: defaultdict(float))
    for r in queries.members_by_hash(spark, data).filter("content_hash <> ''").collect():
        for field in ("license", "category", "path", "repo"):
            value = r[field]
            if value is None or field == "license" and value.strip(" ") in ("", "NOASSERTION") or field == "category" and value == "uncategorised":
                continue
            votes[r["content_hash"], field][value] += math.log1p(r["stars"] or 0) + 1
    assert any(len(v) > 1 for v in votes.values())
    got = {(r["content_hash"], f): r[f] for r in chosen for f in ("license", "category", "path", "repo") if r[f] is not None}
    want = {}
    for k, v in votes.items():
        order = sorted(v, key=lambda x: (-v[x], x))
        want[k] = brute(order, [v[x] for x in order])
    assert got == want


def brute(values, weights):
    """Progressive alignment in plain loops, values in order of weight."""
    lists = [survivor.TOKEN.findall(v) for v in values]
    profile, total = [], 0.0
    for tokens, weight in zip(lists, weights):
        n, m = len(profile), len(tokens)
        score = {(0, 0): (0.0, None)}
        for i in range(n + 1):
            for j in range(m + 1):
                ways = []
                if i and j:
                    share = profile[i - 1].get(tokens[j - 1], 0.0) / total
                    ways.append((score[i - 1, j - 1][0] + (share or -0.7), "both"))
                if i:
                    ways.append((score[i - 1, j][0] - 0.3, "left"))
                if j:
                    ways.append((score[i, j - 1][0] - 0.3, "right"))
                if ways:
                    top = max(s for s, _ in ways)
                    score[i, j] = next((s, w) for s, w in ways if s > top - 1e-9)
        out, i, j = [], n, m
        while i or j:
            way = score[i, j][1]
            column = dict(profile[i - 1]) if way != "right" else {"": total}
            token = tokens[j - 1] if way != "left" else ""
            column[token] = column.get(token, 0.0) + weight
            out.append(column)
            i, j = i - (way != "right"), j - (way != "left")
        profile, total = out[::-1], total + weight
    wanted = [t for t in (max(c, key=lambda t: (c[t], t)) for c in profile) if t]
    return values[min(range(len(values)), key=lambda i: (edits(lists[i], wanted), -weights[i], values[i]))]
