"""Ranked lists: fusing, collapsing copies, diversifying, paging.

Lists may be of any size: places come from range-partitioned ranks. Where the caller
has bounded a list with a top-k, ``bounded`` takes them from one window instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranks import global_rank

# Constant of reciprocal rank fusion and the channels' weights.
RRF_K = 20
CHANNEL_WEIGHTS = {"keyword": 1.0, "vector": 0.9, "quality": 0.5}


def positions(df: DataFrame, order: Sequence[Column], out: str = "pos", within: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """1-based places in a list (or in each list ``within``); ``order`` must be unique."""
    if bounded:
        groups = [F.col(c) for c in within] or [F.lit(0)]
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    ranked = global_rank(df, within, order, out)
    return ranked.withColumn(out, (F.col(out) + 1).cast("int"))


def fuse(channels: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None, k: int = RRF_K,
         quality: tuple[DataFrame, str] | None = None, bounded: bool = False) -> DataFrame:
    """(key, rank, matched_by): reciprocal rank fusion of lists (key, pos).

    quality: (rows (key, ..., column), column): ranks the retrieved keys by a
        column of their own, so that it reorders and never adds.
    matched_by joins the names of the channels that found the key, in order.
    """
    w = {**CHANNEL_WEIGHTS, **(weights or {})}
    parts = None
    for name, df in channels.items():
        one = df.select(key, F.lit(name).alias("_c"), (F.lit(w.get(name, 1.0)) / (F.lit(k) + F.col("pos"))).alias("_s"))
        parts = one if parts is None else parts.unionByName(one)
    found = parts.groupBy(key).agg(F.sum("_s").alias("rank"), F.array_join(F.array_sort(F.collect_set("_c")), "+").alias("matched_by"))
    if quality is None:
        return found
    rows, column = quality
    ranked = positions(found.join(rows.select(key, F.col(column).alias("_q")), key), [F.col("_q").desc_nulls_last(), F.col(key)], "_p", bounded=bounded)
    return ranked.select(key, (F.col("rank") + F.lit(w["quality"]) / (F.lit(k) + F.col("_p"))).alias("rank"), "matched_by")


def collapse_duplicates(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """One row per non-empty ``group``, the best by ``score`` (ties: smallest key), with ``duplicates``,
    the number of rows it stands for besides itself. Null and empty groups are never merged.
    """
    named = F.coalesce(F.col(group) != "", F.lit(False))
    rows = F.struct(*[F.col(c) for c in df.columns])
    single = df.filter(~named).withColumn("duplicates", F.lit(0).cast("bigint"))
    best = df.filter(named).groupBy(group).agg(
        F.max_by(rows, F.struct(F.col(score), -F.col(key))).alias("_r"), (F.count("*") - 1).alias("duplicates"))
    return single.unionByName(best.select("_r.*", "duplicates"))


def diversify(df: DataFrame, group: str, order: Sequence[Column], most: int = 3, out: str = "pos", bounded: bool = False) -> DataFrame:
    """Places in the list after at most ``most`` rows of a group keep theirs; the rest queue behind."""
    ranked = positions(df, order, "_nth", [group], bounded)
    marked = ranked.withColumn("_over", (F.col("_nth") > most).cast("int")).drop("_nth")
    return positions(marked, [F.col("_over"), *order], out, bounded=bounded).drop("_over")


def diversified_top(df: DataFrame, group: str, order: Sequence[Column], most: int, k: int, out: str = "pos") -> DataFrame:
    """The first ``k`` rows of :func:`diversify` over all of ``df``, which may be of any size.

    The k-th row of a group stands at place k or later, so no row behind it in its
    group is wanted: Spark drops these before the shuffle (or, for a ``k`` beyond its
    limit for that, ranks are taken in ranges), and the rest is a top-k. ``order`` must be unique.
    """
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_nth") <= k)
    else:
        ranked = global_rank(df, [group], order, "_nth").withColumn("_nth", F.col("_nth") + 1)
    marked = ranked.withColumn("_over", (F.col("_nth") > most).cast("int")).drop("_nth")
    first = marked.orderBy("_over", *order).limit(k)
    return positions(first, [F.col("_over"), *order], out, bounded=True).drop("_over")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of a sorted list."""
    return df.orderBy(*order).offset(offset).limit(limit)


def merge_channels(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two lists, one row per key, rows of the first list preferred."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).filter("_r = 1").drop("_o", "_r")


def overlap(left: Column, right: Column) -> Column:
    """Share of the left array's members that the right one has; null for an empty left one."""
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, right)) / F.size(F.array_distinct(left)))
