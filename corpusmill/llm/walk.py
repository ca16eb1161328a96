"""Problem 5: one ranking from several differently scaled scores.

A rank walk: from an item, pick one of the scores, propose another item
uniformly at random, and go there if the score ranks it higher (half the time
if equal). Only ranks matter, so no score dominates by its range. The mass that
flows into an item in one step depends on the mass below it, which is a prefix
sum over the items sorted by that score; no pair of items is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.latest import salted_lookup
from corpusmill.operators.ranks import global_rank, prefix_sums
from corpusmill.runtime import cores, discard, materialise


def _long(df: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    """(key, c, v): one row per item and non-null score; NaN counts as null."""
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(s).cast("double").alias("v")) for i, s in enumerate(scores)])
    rows = df.select(F.col(key), F.explode(each).alias("_s")).select(key, "_s.c", "_s.v")
    return rows.filter(F.col("v").isNotNull() & ~F.isnan("v"))


HOT = 20_000
SALTS = 64
BLOCKS = 4096


def placed(base: DataFrame, key: str, hot_rows: int = HOT) -> DataFrame:
    """(key, places): what doesn't change from step to step, one entry a score.

    An entry is (c, b, s, v, n, stays, hot). n: items in the chain of score c; stays:
    share of an item's proposals not ranked higher, equal ones counting half; b: its
    block of neighbouring values. A value that more than ``hot_rows`` items have, and
    more than one in ``BLOCKS``, is hot: it is a block by itself, over which its
    items are spread by the salt s. So a chain has at most 3 * ``BLOCKS`` blocks.
    """
    spark = base.sparkSession
    sizes = base.groupBy("c").agg(F.count("*").alias("n"))  # one row per score
    values = base.groupBy("c", "v").agg(F.count("*").alias("vn")).join(F.broadcast(sizes), "c")
    hot = F.col("vn") > F.greatest(F.lit(hot_rows), F.col("n") / BLOCKS)
    below = prefix_sums(values, ["c"], [F.col("v")], {"n_below": F.col("vn"), "hot_below": hot.cast("bigint")})
    blocks = F.greatest(F.lit(min(cores(spark), BLOCKS)), F.least(F.ceil(F.col("n") / 50_000), F.lit(BLOCKS)))
    found = below.select("c", "v", "n", "vn", hot.alias("hot"), ((F.col("n_below") + F.col("vn") / 2) / F.col("n")).alias("stays"),
                         (F.floor(F.col("n_below") * blocks / F.col("n")) + 2 * F.col("hot_below") + hot.cast("bigint")).alias("b"))
    rows = salted_lookup(base, materialise(found, "values"), ["c", "v"], F.col(key), "vn")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(key), F.lit(SALTS))).otherwise(0).cast("int").alias("s")
    return rows.groupBy(key).agg(F.collect_list(F.struct("c", "b", salt, "v", "n", "stays", "hot")).alias("places"))


def step(items: DataFrame, key: str) -> DataFrame:
    """One step of every score's chain: (key, m, last, p, flow) for each item and score.

    items: (key, places, m, last) with m, the item's mass times the number n of items
    in the chain, so that the uniform start has m = 1 and numbers stay near 1 at
    every size. An item's new mass is what its proposals fail to move plus what
    arrives from items below:
    m * (1 - (higher + equal/2)/n) + (mass below + equal mass/2)/n.
    Mass below is summed inside blocks of values, to which the totals of earlier
    blocks are added; those are few by construction and broadcast. All items of a
    hot value's block are equal, so its total is all they need.
    """
    long = items.select(key, "m", "last", F.explode("places").alias("p"))
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = long.groupBy("p.c", "p.b").agg(F.sum("m").alias("bm"))
    totals = totals.select(F.col("c").alias("tc"), F.col("b").alias("tb"), "bm", F.coalesce(F.sum("bm").over(earlier), F.lit(0.0)).alias("m_before"))
    rows = long.join(F.broadcast(totals), (F.col("p.c") == F.col("tc")) & (F.col("p.b") == F.col("tb")))
    block = [F.col("p.c"), F.col("p.b"), F.col("p.s")]
    upto = F.sum("m").over(Window.partitionBy(*block).orderBy("p.v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("m").over(Window.partitionBy(*block, F.col("p.v")))
    inside = F.when(F.col("p.hot"), F.col("bm") / 2).otherwise(upto - equal / 2)
    return rows.select(key, "m", "last", "p", (F.col("m") * F.col("p.stays") + (F.col("m_before") + inside) / F.col("p.n")).alias("flow"))


def rank_walk(df: DataFrame, key: str, scores: Sequence[str], steps: int | None = None, damping: float = 0.85,
              at_least: int = 1, tolerance: float = 1e-9, hot_rows: int = HOT) -> DataFrame:
    """Items by the mass the damped walk leaves on them: ``(key, mass, n_scores, mid_rank)``.

    df: one row per key. An item takes part in the chain of each score it has;
    its mass is the mean over these chains, and items with fewer than
    ``at_least`` scores are left out of the result (they still stand in the
    chains, as their values are part of each score's distribution). Mass is
    relative: 1 is an even share. mid_rank is the mean of the item's mid-rank
    positions, the share of its proposals that stay.

    Power iteration ends when a step of the walk changes no item's mass by more
    than ``tolerance``, so what is missing is at most tolerance / (1 - damping).
    Between two steps the mass is carried on along the last two (the limit of
    Chebyshev's weights for a walk whose shares lie in 0..damping), which needs a
    quarter of the steps; should a step move more than the ones before, the plain iteration
    goes on, whose missing part shrinks by ``damping`` a step. With ``steps``
    exactly so many plain steps are taken; without damping they must be given.

    Null keys are left out, as are null and NaN scores. An item without scores
    has no mass and is dropped. An empty table gives an empty result.
    """
    if steps is None and not 0 <= damping < 1:
        raise ValueError("without damping the number of steps must be given")
    base = _long(df.filter(F.col(key).isNotNull()), key, scores)
    items = placed(materialise(base, "scores"), key, hot_rows)
    items = materialise(items.select(key, "places", F.lit(1.0).alias("m"), F.lit(1.0).alias("last")), "walk")
    plain, least = steps is not None, float("inf")
    pull, reach = 2 / (2 - damping), damping / (2 - damping)
    rho = 2 / (1 + (1 - reach**2) ** 0.5)  # the same in every step, and so is its compiled code
    done = 0
    while True:
        done += 1
        m, walked = F.first("m"), F.lit(damping) * F.avg("flow") + F.lit(1 - damping)  # m and last are the same in all chains
        onward = walked if plain else F.lit(rho) * (F.lit(pull) * walked + F.lit(1 - pull) * m) + F.lit(1 - rho) * F.first("last")
        after = step(items, key).groupBy(key).agg(
            F.collect_list("p").alias("places"), onward.alias("m"), m.alias("last"), walked.alias("mass"), F.count("*").alias("n_scores"),
            F.avg("p.stays").alias("mid_rank"), F.abs(walked - m).alias("_moved"))
        if done == steps:
            break
        after = materialise(after, "walk")
        discard(items)
        items = after
        moved = items.agg(F.max("_moved")).first()[0] or 0
        if moved <= tolerance:
            break
        if not plain and moved > 2 * least:
            plain, items = True, items.withColumn("m", F.col("mass"))
        least = min(least, moved)
    return after.filter(F.col("n_scores") >= at_least).select(key, "mass", "n_scores", "mid_rank")


def first_share(ranked: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The first ``k`` rows by ``value`` (highest first, then ``key``), however large k is.

    Places come from range partitions, so no task ever holds k rows. Values are
    compared to 12 decimals, so that sums added in another order tie.
    """
    order = [F.round(value, 12).desc(), F.col(key).asc()]
    return global_rank(ranked, [], order, "_place").filter(F.col("_place") < k).drop("_place")
