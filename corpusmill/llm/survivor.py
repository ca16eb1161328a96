"""Problem 3: the best representative of each duplicate group.

Two operators: :func:`survivors` picks winners field by field by a stated order,
:func:`consensus` aligns the distinct values of a field token by token, votes
with weights and returns the existing value closest to the consensus.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.latest import salted_lookup
from corpusmill.runtime import materialise

TOKEN = re.compile(r"\w+|[^\w\s]")


def best(value: Column, order: Sequence[Column], among: Column | None = None) -> Column:
    """Aggregate: ``value`` of the row that is greatest by ``order``, null if none.

    Nulls in ``order`` are lowest. Only rows where ``among`` holds compete. It
    is ``max_by`` over a struct, so rows are combined before any shuffle.
    """
    key = F.struct(*order)
    return F.max_by(value, F.when(among, key) if among is not None else key)


def survivors(df: DataFrame, group: str, member: str, fields: Mapping[str, tuple[Sequence[Column], Column | None]]) -> DataFrame:
    """For each ``group`` carried by two or more ``member`` ids, one id per field.

    fields: output column -> (order, among): the member greatest by ``order``
        among the rows where ``among`` holds gives its id; 0 if there is none.
        End each order with the negated member id to break ties by the smallest.

    Rows with a null or empty group, or a null member, take no part. Repeated
    rows of a member count once for the group's size and can't change a winner.
    An empty table gives an empty result.
    """
    rows = df.filter(F.col(group).isNotNull() & (F.col(group) != "") & F.col(member).isNotNull())
    picked = rows.groupBy(group).agg(
        F.min(member).alias("_least"), F.max(member).alias("_most"),
        *[F.coalesce(best(F.col(member), order, among), F.lit(0)).alias(out) for out, (order, among) in fields.items()],
    )
    return picked.filter("_least <> _most").select(group, *fields)


def clean_hash(column: str) -> Column:
    """A content hash without the ways it is written: trimmed, lower case, no ``sha256:``."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), "^sha256:", "")


Columns = list[dict[str, float]]  # votes by token, "" is a gap
GAP, MISMATCH, SAME = -0.3, -0.7, 1e-9


def align(left: Columns, left_total: float, right: Columns, right_total: float) -> Columns:
    """Align two weighted profiles and add up their votes.

    Global alignment: two columns earn the chance that a vote of each agree,
    columns without a common token cost more than two gaps. A value is a profile
    of columns with one vote each. The totals are the votes of each side, which
    also those without a column of their own cast, as gaps. Ways that cost the
    same up to ``SAME`` tie: both columns first, then one of the left.
    """
    n, m = len(left), len(right)
    places: dict[str, list[tuple[int, float]]] = {}
    for j, column in enumerate(right):
        for t, w in column.items():
            if t:
                places.setdefault(t, []).append((j, w / right_total))
    slope = GAP * np.arange(m + 1)
    last = slope.copy()
    came = np.zeros((n + 1, m + 1), dtype=np.uint8)  # 0 both, 1 left only, 2 right only
    came[0, 1:], came[1:, 0] = 2, 1
    for i, column in enumerate(left, 1):
        same = np.zeros(m)
        for t, w in column.items():
            for j, share in places.get(t, ()) if t else ():
                same[j] += share * w / left_total
        both = last[:-1] + np.where(same > 0, same, MISMATCH)
        here = last + GAP
        came[i, 1:] = both < here[1:] - SAME
        here[1:] = np.maximum(both, here[1:])
        here -= slope  # a run of gaps on the right is a running maximum
        most = np.maximum.accumulate(here)
        came[i][most > here + SAME] = 2
        last = most + slope
    out: Columns = []
    i, j = n, m
    while i or j:
        way = came[i, j]
        a, b = {"": left_total} if way == 2 else left[i - 1], {"": right_total} if way == 1 else right[j - 1]
        out.append({t: a.get(t, 0.0) + b.get(t, 0.0) for t in {**a, **b}})
        i, j = i - (way != 2), j - (way != 1)
    return out[::-1]


def profile_of(values: Sequence[str], weights: Sequence[float]) -> tuple[Columns, float]:
    """The profile of ``values`` and its votes, the heaviest aligned first (ties by value)."""
    columns: Columns = []
    total = 0.0
    for i in sorted(range(len(values)), key=lambda i: (-weights[i], values[i])):
        own = [{t: weights[i]} for t in TOKEN.findall(values[i])]
        columns = align(columns, total, own, weights[i])
        total += weights[i]
    return columns, total


def agreed(columns: Columns) -> list[str]:
    """The tokens with most votes in their columns, gaps left out."""
    return [t for t in (max(c, key=lambda t: (c[t], t)) for c in columns) if t]


def distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Edits between two token lists."""
    if list(a) == list(b):
        return 0
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in s], dtype=np.int64) for s in (a, b))
    places = np.arange(len(y) + 1)
    last = places.copy()
    for t in x:
        now = last + 1
        now[1:] = np.minimum(now[1:], last[:-1] + (y != t))
        last = np.minimum.accumulate(now - places) + places
    return int(last[-1])


def vote(values: Sequence[str], weights: Sequence[float]) -> str:
    """The existing value closest to the token-level consensus of all values."""
    wanted = agreed(profile_of(values, weights)[0])
    return values[min(range(len(values)), key=lambda i: (distance(TOKEN.findall(values[i]), wanted), -weights[i], values[i]))]


def consensus(df: DataFrame, group: str | Sequence[str], value: str, weight: Column, out: str = "value", block: int = 64) -> DataFrame:
    """Per ``group`` (one or more columns) the existing ``value`` closest to the group's token consensus.

    Equal values are merged before anything is gathered and their weights added
    (null or non-positive weights count as 0). Groups of up to ``block`` distinct
    values are decided at once. Larger ones are aligned in blocks of about that
    many; the blocks' profiles, with all their columns and votes, are merged by
    eights until one is left, and every distinct value is compared with what it
    agrees on, so no task holds a whole group and no value or vote is lost. Every
    token of a value takes part; equal distance is decided by weight, then value.
    Null groups and null values take no part; a group of nulls only does not appear.
    """
    by = [group] if isinstance(group, str) else list(group)
    present = [F.col(c).isNotNull() for c in [*by, value]]
    for p in present[1:]:
        present[0] = present[0] & p
    named = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
    g = [f"g{i}" for i in range(len(by))]
    g_types = ", ".join(f"{x} {df.schema[c].dataType.simpleString()}" for x, c in zip(g, by))
    result = [*[F.col(x).alias(c) for x, c in zip(g, by)], F.col("v").alias(out)]
    vote_weight = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)) + F.lit(1e-9)
    values = df.filter(present[0]).groupBy(*named, F.col(value).alias("v")).agg(F.round(F.sum(vote_weight), 9).alias("w"))
    values = materialise(values, "values")
    sizes = values.groupBy(*g).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    sizes = materialise(sizes, "sizes")
    largest = sizes.agg(F.max("parts")).first()[0] or 0

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["v"] = [v[0] if len(v) == 1 else vote(list(v), list(w)) for v, w in zip(frame["vs"], frame["ws"])]
            yield frame[[*g, "v"]]

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["profile"] = [json.dumps(profile_of(list(v), list(w))) for v, w in zip(frame["vs"], frame["ws"])]
            yield frame[[*g, "p", "profile"]]

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for each in frame["profiles"]:
                columns, total = json.loads(each[0])
                for other, votes in map(json.loads, each[1:]):
                    columns, total = align(columns, total, other, votes), total + votes
                rows.append(json.dumps((columns, total)))
            frame["profile"] = rows
            yield frame[[*g, "p", "profile"]]

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["wanted"] = [agreed(json.loads(x)[0]) for x in frame["profile"]]
            yield frame[[*g, "wanted"]]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["d"] = [distance(TOKEN.findall(v), list(t)) for v, t in zip(frame["v"], frame["wanted"])]
            yield frame[[*g, "v", "w", "d"]]

    def gathered(rows: DataFrame, *keys: str) -> DataFrame:
        blocks = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("x"))
        return blocks.select(*keys, F.col("x.v").alias("vs"), F.col("x.w").alias("ws"))

    if largest <= 1:
        return gathered(values, *g).mapInPandas(decide, f"{g_types}, v string").select(*result)
    values = materialise(salted_lookup(values, sizes, g, F.col("v"), "n"), "sized")
    small = gathered(values.filter("parts = 1"), *g).mapInPandas(decide, f"{g_types}, v string")
    large = values.filter("parts > 1").withColumn("p", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    level = gathered(large, *g, "p").mapInPandas(profiles, f"{g_types}, p int, profile string")
    while largest > 1:
        fewer = materialise(level, "profiles").groupBy(*g, F.floor(F.col("p") / 8).cast("int").alias("p")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("p").alias("o"), "profile"))).alias("x"))
        level = fewer.select(*g, "p", F.col("x.profile").alias("profiles")).mapInPandas(merged, f"{g_types}, p int, profile string")
        largest = -(-largest // 8)
    wanted = materialise(level.mapInPandas(tokens, f"{g_types}, wanted array<string>"), "agreed")
    wanted = wanted.join(sizes.select(*g, "n"), g)
    near = salted_lookup(large.drop("n"), wanted, g, F.col("v"), "n").mapInPandas(compared, f"{g_types}, v string, w double, d int")
    closest = near.groupBy(*g).agg(F.min_by("v", F.struct("d", -F.col("w"), "v")).alias("v"))
    return small.unionByName(closest).select(*result)
