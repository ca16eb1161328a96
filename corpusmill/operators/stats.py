"""Exact quantile boundaries, document frequencies, samples and counts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranks import prefix_sums


def unpivot(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """(metric, v) of all non-null values, in one pass over the rows."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("v")) for m, c in metrics.items()])
    return df.select(F.explode(each).alias("_x")).select("_x.metric", "_x.v").filter("v IS NOT NULL")


def quantile_boundaries(long: DataFrame, parts: int = 100, least: int = 8) -> DataFrame:
    """(metric, quantiles, n): ``parts`` + 1 nearest-rank boundaries of each metric's values.

    The boundary of p is the value at 0-based rank round-half-even(p / parts *
    (n - 1)). Metrics with fewer than ``least`` values have none. Values are merged
    first and ranked by distributed prefix sums; each merged value then names the
    boundaries that fall on it, so only the boundaries themselves are gathered.
    """
    merged = long.groupBy("metric", "v").agg(F.count("*").alias("_c"))
    totals = merged.groupBy("metric").agg(F.sum("_c").alias("n")).filter(F.col("n") >= least)
    placed = prefix_sums(merged.withColumn("_cnt", F.col("_c")), ["metric"], [F.col("v")], {"_before": F.col("_cnt")})
    rows = placed.join(F.broadcast(totals), "metric")  # one row a metric
    rank = lambda p: F.bround(p.cast("double") / F.lit(float(parts)) * (F.col("n") - 1), 0)
    step = F.lit(float(parts)) / (F.col("n") - 1)
    low = F.greatest(F.lit(0), F.floor((F.col("_before") - 1) * step)).cast("int")  # boundaries that may fall on the value
    high = F.least(F.lit(parts), F.ceil((F.col("_before") + F.col("_c")) * step)).cast("int")
    hit = F.filter(F.sequence(low, high), lambda p: (rank(p) >= F.col("_before")) & (rank(p) < F.col("_before") + F.col("_c")))
    found = rows.select("metric", "n", "v", F.explode(hit).alias("p"))
    return found.groupBy("metric").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", "v"))).alias("_q")).select(
        "metric", F.col("_q.v").alias("quantiles"), "n")


def document_frequency(df: DataFrame, words: Column) -> DataFrame:
    """(term, df): in how many rows each word occurs."""
    return df.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def pattern_idf(df: DataFrame, text: Column, patterns: Mapping[str, str], floor: float = 0.35) -> DataFrame:
    """(pattern, df, idf) of regular expressions: idf = max(floor, ln((n + 1) / (df + 1))), one pass."""
    names = list(patterns)
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(text.rlike(patterns[p])).alias(f"_d{i}") for i, p in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"_d{i}").alias("df")) for i, p in enumerate(names)]))
    rows = counted.select("_n", each.alias("_x")).select("_n", "_x.pattern", "_x.df")
    return rows.select("pattern", "df", F.greatest(F.lit(floor), F.log((F.col("_n") + 1) / (F.col("df") + 1))).alias("idf"))


def stratified_sample(df: DataFrame, stratum: str, key: str, k: int, seed: int = 7) -> DataFrame:
    """Up to ``k`` rows of each stratum, chosen by a seeded hash of the key: repeatable at any partitioning."""
    drawn = F.xxhash64(F.col(key), F.lit(seed))
    first = df.withColumn("_d", drawn).withColumn("_s", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(32)))
    # Each slice of a stratum keeps k, so that no window sees a whole hot stratum.
    local = Window.partitionBy(stratum, "_s").orderBy("_d", key)
    kept = first.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_d", key))).filter(F.col("_r") <= k).drop("_d", "_s", "_r")


def tally(df: DataFrame, *columns: str) -> DataFrame:
    """Counts per combination of values, as ``n``."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def category_tree(df: DataFrame, top: str, sub: str) -> DataFrame:
    """(top, sub, n) with the total of each top in the row whose sub is null, from one rollup."""
    rows = df.filter(F.col(top).isNotNull()).rollup(top, sub).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return rows.filter((F.col("_g") == 1) | ((F.col("_g") == 0) & F.col(sub).isNotNull())).select(top, sub, "n")


def top_groups(df: DataFrame, group: str, value: str, k: int, out: str = "total") -> DataFrame:
    """The ``k`` groups with the largest sum; ties go to the smaller name."""
    return df.groupBy(group).agg(F.sum(value).alias(out)).orderBy(F.col(out).desc_nulls_last(), F.col(group)).limit(k)


def upper_bound(k: int, n: int, confidence: float = 0.95) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate after k cases in n draws; 1 for no draws.

    Two-sided, but after no case at all one-sided, as there is nothing below.
    """
    if n <= 0:
        return 1.0
    if k >= n:
        return 1.0
    if k == 0:
        return 1.0 - (1.0 - confidence) ** (1.0 / n)
    alpha = (1.0 - confidence) / 2

    def tail(p: float) -> float:  # P(X <= k)
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    lo, hi = k / n, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > alpha else (lo, mid)
    return hi


def best_per_group(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The greatest row of each group by ``order`` (nulls lowest), as an aggregation."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(group).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")
