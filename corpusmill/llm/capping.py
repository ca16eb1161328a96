"""Problem 6: a cap on the records of each dominant contributor.

The cap of a contributor is split over strata (topics, periods) by
largest-remainder apportionment, spare slots go to strata that still have rows,
and inside each stratum the best rows by quality are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.latest import salted_lookup
from corpusmill.runtime import materialise


def apportion(counts: DataFrame, contributor: Sequence[str], stratum: Sequence[str], cap: int, split: str) -> DataFrame:
    """Add ``quota``, the slots of each stratum, to (contributor, stratum, n) rows.

    ``proportional``: shares follow the stratum sizes; floors first, remaining
    slots by largest remainder. No stratum can then get more than it has.
    ``equal``: every stratum gets the same share; slots that small strata can't
    fill are redistributed among the rest until all are used (water filling),
    the last ones by largest remainder. Ties go to larger, then first strata.
    """
    whole = Window.partitionBy(*contributor)
    order = [F.col(c).asc_nulls_last() for c in stratum]
    rows = counts.withColumn("_total", F.sum("n").over(whole))
    if split == "equal":
        rising = Window.partitionBy(*contributor).orderBy(F.col("n"), *order)
        before = rising.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_left", F.lit(cap) - F.coalesce(F.sum("n").over(before), F.lit(0)))
        rows = rows.withColumn("_open", F.count("*").over(whole) - F.row_number().over(rising) + 1)
        # Level of the water: the first stratum that can't be filled sets it for all larger ones.
        rows = rows.withColumn("_fits", F.col("n") * F.col("_open") <= F.col("_left"))
        rows = rows.withColumn("_place", F.row_number().over(rising))
        rows = rows.withColumn("_first", F.min(F.when(~F.col("_fits"), F.struct("_place", "_left", "_open"))).over(whole))
        exact = F.when(F.col("_first").isNull() | (F.col("_place") < F.col("_first._place")), F.col("n") * F.lit(1.0)).otherwise(
            F.col("_first._left") / F.col("_first._open"))
    else:
        exact = F.when(F.col("_total") <= cap, F.col("n") * F.lit(1.0)).otherwise(F.lit(float(cap)) * F.col("n") / F.col("_total"))
    rows = rows.withColumn("_exact", exact).withColumn("_base", F.floor("_exact").cast("bigint"))
    rows = rows.withColumn("_spare", F.least(F.lit(cap), F.col("_total")) - F.sum("_base").over(whole))
    room = F.col("n") > F.col("_base")
    by_rest = Window.partitionBy(*contributor).orderBy(
        room.desc(), (F.col("_exact") - F.col("_base")).desc(), F.col("n").desc(), *order)
    extra = F.when(room & (F.row_number().over(by_rest) <= F.col("_spare")), 1).otherwise(0)
    return rows.withColumn("quota", F.col("_base") + extra).select(*contributor, *stratum, "n", "quota")


def beyond_cap(df: DataFrame, key: str, contributor: Sequence[str], quality: Column, cap: int,
               stratum: Sequence[str] = (), split: str = "proportional", salts: int | None = None) -> DataFrame:
    """Rows that the cap leaves out, as (key, contributor..., stratum...).

    df: narrow rows, unique by ``key``. Rows are ranked by ``quality`` (null is
    lowest), then by the smallest key. Nulls in contributor or stratum columns
    form a group of their own. Contributors with at most ``cap`` rows lose none.
    An empty table gives an empty result; cap 0 leaves out everything.

    Only strata of contributors above the cap are ranked at all, and these first
    in slices of a stratum: the quota-th best row of a stratum is among the first
    quota of its slice, so a second window over the slice leaders finds the last
    kept row, and every row is compared with that row alone. A stratum of n rows has
    sqrt(n / quota) slices (or ``salts``), so that a slice and all its leaders are
    alike in size: no window sees more than sqrt(n * quota) rows, about.
    """
    parts = [*contributor, *stratum]
    n_owner = len(contributor)
    group = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(parts)])  # equal also where parts are null
    rows = materialise(df.select(F.col(key), F.coalesce(quality.cast("double"), F.lit(float("-inf"))).alias("_q"),
                                 group.alias("_g")), "capped")
    tags = [f"_k{i}" for i in range(len(parts))]
    counts = rows.groupBy("_g").agg(F.count("*").alias("n")).select("n", *[F.col("_g")[t].alias(t) for t in tags])
    quotas = apportion(counts, tags[:n_owner], tags[n_owner:], cap, split).filter("n > quota")
    quotas = materialise(quotas.select(F.struct(*tags).alias("_g"), "n", "quota"), "quotas")
    over = materialise(salted_lookup(rows, quotas, ["_g"], F.col(key), "n"), "over")
    slices = F.lit(salts) if salts else F.ceil(F.sqrt(F.col("n") / F.greatest(F.col("quota"), F.lit(1))))
    slice_ = F.pmod(F.xxhash64(key), slices)
    first = [F.col("_q").desc(), F.col(key).asc()]
    leaders = over.withColumn("_s", slice_).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_g", "_s").orderBy(*first))).filter("_r <= quota")
    cut = leaders.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*first))).filter("_r = quota").select(
        "_g", "n", F.col("_q").alias("_cq"), F.col(key).alias("_ck"))
    judged = salted_lookup(over.drop("n"), cut, ["_g"], F.col(key), "n")
    worse = judged.filter((F.col("_q") < F.col("_cq")) | ((F.col("_q") == F.col("_cq")) & (F.col(key) > F.col("_ck"))))
    empty = over.filter("quota = 0")
    back = [F.col("_g")[t].alias(c) for c, t in zip(parts, tags)]
    return worse.select(key, *back).unionByName(empty.select(key, *back))
