"""Global ranks and prefix sums without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.runtime import materialise, tasks_for


def prefix_sums(df: DataFrame, within: Sequence[str], order: Sequence[Column], weights: Mapping[str, Column],
                partitions: int | None = None) -> DataFrame:
    """Add a column per entry of ``weights``: its sum over the rows before each row.

    Rows are ordered by ``order`` inside each group ``within`` (nulls form a
    group). They are range-partitioned by both, so a hot group spreads over many
    partitions; each partition sums its own rows, and the totals of earlier
    partitions, of which there are (partitions x groups in them), are joined as
    offsets. Equal order keys keep an arbitrary order; make ``order`` unique
    where that matters. Weights must not be null. Columns named like an output
    are replaced.
    """
    n = partitions or tasks_for(df)
    kept = [c for c in df.columns if c not in weights]
    w = {out: f"_w{i}" for i, out in enumerate(weights)}
    keyed = df.select(*kept, *[weights[out].alias(w[out]) for out in weights])
    ranged = keyed.repartitionByRange(n, *[F.col(c) for c in within], *order)
    placed = materialise(ranged.withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = placed.groupBy("_pid", *within).agg(*[F.sum(c).alias(c) for c in w.values()])
    groups = list(within) or [F.lit(0)]
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *within, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in w.values()])
    own = Window.partitionBy("_pid", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select(*kept, "_pid", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(c) for c in w.values()])
    joined = summed.alias("l").join(
        offsets.alias("r"),
        [F.col("l._pid") == F.col("r._pid"), *[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in within]],
    )
    return joined.select(*[F.col(f"l.`{c}`") for c in kept], *[(F.col(f"l.{c}") + F.col(f"r.{c}")).alias(out) for out, c in w.items()])


def global_rank(df: DataFrame, within: Sequence[str], order: Sequence[Column], out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Add ``out``: the row's 0-based place in its group, by ``order``."""
    return prefix_sums(df, within, order, {out: F.lit(1).cast("bigint")}, partitions)
