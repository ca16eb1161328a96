"""Problem 1: percentiles of very large numeric columns, per group.

Distributed multi-select. Values are first merged into (group, value, count) and
spread by value, so that a group of any size lies in many partitions. Then, in
rounds: every partition proposes its local median of each open range, the
weighted median of the proposals becomes the range's pivot, all partitions count
below / equal / above, ranges that hold no wanted rank are discarded, and the
rest goes on until every wanted rank is found (or known well enough). One Spark
job a round: counting against the pivots and proposing medians for both sides
are the same pass. A group of few values lies in one partition, whose medians are
then the pivots: all its rounds take place inside that task, at once for all such
groups, so that many small groups need one job and not rounds of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranks import global_rank, prefix_sums
from corpusmill.runtime import cores, materialise

ROUND_SCHEMA = "seg bigint, lt bigint, eq bigint, gt bigint, lm double, lw bigint, hm double, hw bigint"


def _median_of(column: str, weight: str) -> Column:
    """Weighted median of the partitions' proposals (one row a partition)."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(weight) > 0, F.struct(F.col(column).alias("m"), F.col(weight).alias("w")))))
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(None).cast("double").alias("p"))
    total = F.sum(weight)
    return F.aggregate(
        ordered, start,
        lambda a, x: F.struct(
            (a["s"] + x["w"]).alias("s"),
            F.when(a["p"].isNull() & (2 * (a["s"] + x["w"]) >= total), x["m"]).otherwise(a["p"]).alias("p"),
        ),
    )["p"]


def _sorted(g: np.ndarray, v: np.ndarray) -> bool:
    return bool(((g[1:] > g[:-1]) | ((g[1:] == g[:-1]) & (v[1:] >= v[:-1]))).all())


def _pass(values: DataFrame, state) -> DataFrame:
    """Counts of every open range against its pivot, and local medians of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        g, v, c = (t.column(i).to_numpy() for i in range(3))
        if not _sorted(g, v):  # files are written in order, a task may read several
            order = np.lexsort((v, g))
            g, v, c = g[order], v[order], c[order]
        groups, first = np.unique(g, return_index=True)
        last = np.append(first[1:], len(g))
        sg, lo, hi, pivot = state.value
        out = []
        for group, a, b in zip(groups.tolist(), first.tolist(), last.tolist()):
            s, e = np.searchsorted(sg, group), np.searchsorted(sg, group, "right")
            if s == e:
                continue
            x = v[a:b]
            upto = np.concatenate(([0], np.cumsum(c[a:b])))
            p = pivot[s:e]
            i0, i3 = np.searchsorted(x, lo[s:e], "right"), np.searchsorted(x, hi[s:e], "left")
            i3 = np.maximum(i3, i0)
            i1 = np.clip(np.searchsorted(x, p, "left"), i0, i3)
            i2 = np.clip(np.searchsorted(x, p, "right"), i1, i3)
            mid = lambda u, w: x[np.minimum((u + w) // 2, len(x) - 1)]
            out.append((np.arange(s, e), upto[i1] - upto[i0], upto[i2] - upto[i1], upto[i3] - upto[i2],
                        mid(i0, i1), i1 - i0, mid(i2, i3), i3 - i2))
        if out:
            cols = [np.concatenate(y) for y in zip(*out)]
            cols = [y.astype(np.float64 if i in (4, 6) else np.int64) for i, y in enumerate(cols)]
            busy = (cols[1] + cols[2] + cols[3]) > 0
            yield pa.RecordBatch.from_arrays([pa.array(y[busy]) for y in cols],
                                             names=["seg", "lt", "eq", "gt", "lm", "lw", "hm", "hw"])

    local = values.mapInArrow(run, ROUND_SCHEMA)
    return local.groupBy("seg").agg(
        F.sum("lt").alias("lt"), F.sum("eq").alias("eq"), F.sum("gt").alias("gt"),
        _median_of("lm", "lw").alias("lm"), _median_of("hm", "hw").alias("hm"),
    )


def multi_select(values: DataFrame, wanted: dict[int, np.ndarray], epsilon: float = 0.0, keep_share: float = 0.25) -> dict[int, np.ndarray]:
    """For each group the values at 1-based ranks ``wanted[g]`` (within 1..n).

    values: (g int, v double, c bigint), materialised; c copies of v in group g.
    epsilon: with 0 ranks are met exactly; otherwise a value whose rank is off by
        at most epsilon * n may be returned, which saves the last rounds.

    The state held by the driver and sent to the tasks is a few numbers per
    wanted rank of the given groups; callers pass groups in blocks so that it
    stays small. Values in discarded ranges are skipped, and once fewer than
    ``keep_share`` of the rows lie in open ranges they are written anew.
    """
    spark = values.sparkSession
    found = {g: np.full(len(r), np.nan) for g, r in wanted.items()}
    ranks = {g: np.asarray(r, np.int64) for g, r in wanted.items()}
    sizes = {g: 0 for g in wanted}
    # An open range: (group, low, high, values not above low, pivot, indexes of wanted ranks inside).
    open_ = [(g, -np.inf, np.inf, 0, np.nan, np.arange(len(r))) for g, r in sorted(ranks.items()) if len(r)]
    first, rows_now = True, None
    while open_:
        sg = np.array([r[0] for r in open_], np.int64)
        lo, hi = np.array([r[1] for r in open_]), np.array([r[2] for r in open_])
        pivot = np.array([r[4] for r in open_])
        state = spark.sparkContext.broadcast((sg, lo, hi, np.where(np.isnan(pivot), np.inf, pivot)))
        counted = _pass(values, state).toPandas()
        state.destroy()
        by_seg = {int(row.seg): row for row in counted.itertuples(index=False)}
        nxt, active = [], 0
        for i, (g, low, high, base, p, idx) in enumerate(open_):
            row = by_seg.get(i)
            if row is None:
                continue
            if first:  # no pivot yet: everything lies below infinity
                sizes[g] = int(row.lt + row.eq + row.gt)
                nxt.append((g, low, high, base, row.lm, idx))
                active += int(row.lt)
                continue
            want = ranks[g][idx]
            below, upto = base + int(row.lt), base + int(row.lt + row.eq)
            slack = int(epsilon * sizes[g])
            hit = (want > below - slack) & (want <= upto + slack)
            found[g][idx[hit]] = p
            left, right = idx[~hit & (want <= below)], idx[~hit & (want > upto)]
            if len(left):
                nxt.append((g, low, p, base, row.lm, left))
                active += int(row.lt)
            if len(right):
                nxt.append((g, p, high, upto, row.hm, right))
                active += int(row.gt)
        first = False
        open_ = nxt
        total = sum(sizes.values()) if rows_now is None else rows_now
        if open_ and active < keep_share * total and active > 1_000_000:
            values, rows_now = materialise(_inside(values, open_), "open"), active
    return found


def _inside(values: DataFrame, open_: list) -> DataFrame:
    """Only the rows that lie in an open range."""
    bounds = pd.DataFrame([(r[0], r[1], r[2]) for r in open_], columns=["g", "a", "b"])
    ranges = F.broadcast(values.sparkSession.createDataFrame(bounds, "g int, a double, b double"))
    return values.join(ranges, "g").filter("v > a AND v < b").select("g", "v", "c")


def select_whole(values: DataFrame, ranks_of) -> DataFrame:
    """(g, at) for groups that each lie in one partition of ``values`` (g, v, c), sorted by g and v.

    With a single proposer every pivot is the partition's own median, so the rounds
    end at the values where the counts pass the wanted ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            g = t.column("g").to_numpy()
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            if cut:
                yield done(t.slice(0, cut))
            tail = t.slice(cut).to_batches()[0]
        if tail is not None:
            yield done(pa.Table.from_batches([tail]))

    def done(t: pa.Table) -> pa.RecordBatch:
        g, v, upto = t.column("g").to_numpy(), t.column("v").to_numpy(), np.cumsum(t.column("c").to_numpy())
        groups, first = np.unique(g, return_index=True)
        base = np.where(first > 0, upto[first - 1], 0)
        n = np.append(upto[first[1:] - 1], upto[-1]) - base
        ranks = ranks_of(n)
        inside = (ranks >= 1) & (ranks <= n[:, None])
        place = np.searchsorted(upto, np.where(inside, ranks, 1) + base[:, None])
        at = pa.array(v[place].reshape(-1), mask=~inside.reshape(-1))
        return pa.RecordBatch.from_arrays(
            [pa.array(groups), pa.ListArray.from_arrays(pa.array(np.arange(len(groups) + 1) * ranks.shape[1], pa.int32()), at)], names=["g", "at"])

    return values.mapInArrow(run, "g int, at array<double>")


def value_counts(df: DataFrame, group: Sequence[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """(numbered groups (g, _k, n values, m different ones), their values (_k, v, c)), both materialised.

    Null and NaN values take no part; infinite ones count as the largest finite
    double of their sign. Groups with nulls in ``group`` are groups.
    """
    rows = df.select(F.struct(*group).alias("_k"), value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    far = sys.float_info.max
    rows = rows.withColumn("v", F.least(F.greatest(F.col("v"), F.lit(-far)), F.lit(far)))
    merged = materialise(rows.groupBy("_k", "v").agg(F.count("*").alias("c")), "values")
    groups = merged.groupBy("_k").agg(F.sum("c").alias("n"), F.count("*").alias("m"))
    numbered = materialise(global_rank(groups, [], [F.col("_k")], "g").withColumn("g", F.col("g").cast("int")), "groups")
    return numbered, merged


def percentiles(df: DataFrame, group: Sequence[str], value: Column, ranks_of, epsilon: float = 0.0,
                block: int | None = None, whole: int = 65_536) -> DataFrame:
    """Per group the values at the ranks that ``ranks_of(n)`` names.

    ranks_of: from an array of group sizes to an array of 1-based ranks (groups
        x ranks); ranks outside 1..n give null there.
    Returns (group..., n, at: array<double>) with one entry per rank.

    whole: a group of at most so many different values lies in one partition and
        is selected there; larger ones are spread by value, whatever their size,
        and go through the rounds together.
    Groups that need rounds are taken in blocks of ``block`` (by default as many as
    have 400,000 ranks together), so neither the driver nor a broadcast ever holds
    more than block x ranks ranges. A group that has no value does not appear. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    block = block or max(1, 400_000 // ranks_of(np.array([1])).shape[1])
    numbered, merged = value_counts(df, group, value)
    joined = merged.join(numbered.select("_k", "g", "m"), "_k")
    small = joined.filter(F.col("m") <= whole).select("g", "v", "c").repartition(cores(spark), "g").sortWithinPartitions("g", "v")
    out = select_whole(small, ranks_of)
    large = numbered.filter(F.col("m") > whole).select("g", "n")
    spread = joined.filter(F.col("m") > whole).select("g", "v", "c").repartition(cores(spark), "g", "v").sortWithinPartitions("g", "v")
    values = materialise(spread, "spread")
    blocks = sorted(r[0] for r in large.select(F.floor(F.col("g") / block)).distinct().collect())  # a number for every block of groups
    for b in blocks:
        part = large.filter(F.floor(F.col("g") / block) == b).toPandas().sort_values("g")
        ranks = ranks_of(part["n"].to_numpy())
        inside = (ranks >= 1) & (ranks <= part["n"].to_numpy()[:, None])
        wanted = {int(g): np.unique(r[m]) for g, r, m in zip(part["g"], ranks, inside)}
        here = values.filter(F.col("g").between(int(part["g"].iloc[0]), int(part["g"].iloc[-1])))
        found = multi_select(here, wanted, epsilon)
        rows = []
        for g, r, m in zip(part["g"], ranks, inside):
            at = np.full(len(r), np.nan)
            at[m] = found[int(g)][np.searchsorted(wanted[int(g)], r[m])]
            rows.append((int(g), [None if not ok else float(x) for x, ok in zip(at, m)]))
        block_rows = spark.createDataFrame(rows, "g int, at array<double>")
        out = out.unionByName(materialise(block_rows, "selected") if len(blocks) > 1 else block_rows)
    return numbered.join(out, "g").select(*[F.col("_k")[c].alias(c) for c in group], "n", "at")


def even_ranks(parts: int):
    """Nearest ranks of p = 0, 1/parts, ..., 1: the smallest value first, the largest last."""

    def ranks_of(n: np.ndarray) -> np.ndarray:
        p = np.arange(parts + 1)
        return np.maximum(1, -(-(p[None, :] * n[:, None]) // parts)).astype(np.int64)

    return ranks_of


def pieces(df: DataFrame, group: Sequence[str], value: Column, parts: int = 100, epsilon: float = 0.0) -> DataFrame:
    """Mergeable summaries: (group..., n, at) with the ``parts`` + 1 even quantiles.

    Between two neighbouring entries lie at most n/parts + 1 values, so any rank
    read off a piece is off by at most n * (1/parts + epsilon) + 1.
    """
    return percentiles(df, group, value, even_ranks(parts), epsilon)


def merge_pieces(rows: DataFrame, into: Sequence[str], n: str = "n", at: str = "at", parts: int = 100) -> DataFrame:
    """Combine pieces (for instance of many days) into one per ``into``.

    Each entry after a piece's first stands for n/parts values. The weighted
    entries are summed in order and read at p = 0..parts; the rank error of the
    result is at most the sum of the pieces' own, so 1/parts of all values plus
    one value a piece. Pieces with a null, empty or wrongly sized array, or n
    below 1, are left out.
    """
    good = rows.filter((F.col(n) >= 1) & (F.size(at) == parts + 1))
    long = good.select(*into, F.posexplode(at).alias("_i", "v"), F.col(n).alias("_n"))
    weights = long.groupBy(*into, "v").agg(
        F.sum(F.when(F.col("_i") > 0, F.col("_n")).otherwise(0)).cast("bigint").alias("w"))
    totals = good.groupBy(*into).agg(F.sum(n).alias("n"))
    below = prefix_sums(weights.withColumn("_w", F.col("w")), into, [F.col("v")], {"before": F.col("_w")})
    joined = below.alias("b").join(totals.alias("t"), [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in into])
    joined = joined.select(*[F.col(f"b.{c}") for c in into], "v", "w", "before", "n")
    # In units of 1/parts value: entry v covers (before, before + w]; p is met where p * n falls.
    p_first = F.floor(F.col("before") / F.col("n")).cast("int") + F.when(F.col("before") == 0, 0).otherwise(1)
    p_last = F.floor((F.col("before") + F.col("w")) / F.col("n")).cast("int")
    spread = joined.withColumn("_p", F.explode(F.when(p_last >= p_first, F.sequence(p_first, p_last)).otherwise(F.array())))
    picked = spread.groupBy(*into, "_p").agg(F.min("v").alias("v"), F.first("n").alias("n"))
    return picked.groupBy(*into).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("_p", "v"))).alias("_a")).select(
        *into, "n", F.col("_a.v").alias("at"))


def margin_ranks(margin: int, parts: int = 100):
    """Ranks that decide whether a claimed quantile is off by more than margin/parts.

    For p the claim q is too high if more than (p + margin)/parts of the data are
    smaller, that is if the value at rank floor((p + margin) n / parts) + 1 is below
    q; too low if fewer than (p - margin)/parts are not larger, that is if the
    value at rank ceil((p - margin) n / parts) is above q. Whole-number arithmetic.
    """

    def ranks_of(n: np.ndarray) -> np.ndarray:
        p = np.arange(parts + 1)[None, :]
        n = n[:, None].astype(np.int64)
        return np.concatenate(((p + margin) * n // parts + 1, -(-((p - margin) * n) // parts)), axis=1)

    return ranks_of


def misstated(stats: DataFrame, data: DataFrame, group: Sequence[str], value: Column, stat_id: str, claimed: str,
              margin: int = 7, parts: int = 100, block: int | None = None, whole: int = 256) -> DataFrame:
    """Rows of ``stats`` with a claimed quantile misplaced by more than margin/parts.

    stats: (stat_id, group..., claimed: array of parts + 1 values for p = 0..parts).
    data: rows with the group columns and the value; only groups that ``stats``
        names are selected. A claim about a group without data, and null entries
        of a claim, misstate nothing; entries beyond the array are not checked.
    whole: see :func:`percentiles`; claims name few groups, so all but the smallest
        go through the rounds together.
    """
    on = list(group)
    named = stats.select(*on).distinct()
    actual = percentiles(data.join(named, on, "left_semi"), on, value, margin_ranks(margin, parts), block=block, whole=whole)
    joined = stats.join(actual, on)
    checks = F.exists(
        F.arrays_zip(F.col(claimed).alias("q"), F.slice("at", 1, parts + 1).alias("high"),
                     F.slice("at", parts + 2, parts + 1).alias("low")),
        lambda x: F.coalesce(x["high"] < x["q"], F.lit(False)) | F.coalesce(x["low"] > x["q"], F.lit(False)),
    )
    return joined.filter(checks).select(stat_id)
