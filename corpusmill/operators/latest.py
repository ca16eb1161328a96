"""Latest state per key, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import broadcast_if_small, materialise

def latest(df: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Per ``key`` the row with the greatest ``at``, cut to ``columns``.

    An aggregation (``max_by`` of a struct): each task sorts its own rows and
    combines them before the shuffle, so however often a key comes, a row a task
    is all that travels. Rows whose ``at`` is null count
    as oldest; ties are taken to be identical rows. A null key is a key of its
    own. Meant for narrow columns: derive what is needed from long texts first
    and keep the latest of the results, or take :func:`current_rows`, so that
    texts never travel.
    """
    rest = [c for c in columns if c != key]
    far = F.lit("0001-01-01").cast("timestamp")
    picked = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.coalesce(F.col(at), far)).alias("_row")
    )
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def current_rows(df: DataFrame, key: str, at: str, columns: Sequence[str], few: int = 1_000_000) -> DataFrame:
    """What :func:`latest` gives, for wide columns: rows of a key that comes once stay where they are read.

    Keys are counted by a hash aggregation over ``key`` alone. Those that come
    again, if at most ``few``, are broadcast; only their rows are shuffled to
    find the latest. With more of them all rows meet the list in a shuffle.
    """
    again = broadcast_if_small(materialise(df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_again")), "again"), few)
    rows = df.select(*dict.fromkeys([key, at, *columns]))
    same = F.col(key).eqNullSafe(F.col("_again"))
    once, more = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
    wanted = [key, *[c for c in columns if c != key]]
    return once.select(*wanted).unionByName(latest(more, key, at, wanted).select(*wanted))


def salted_lookup(rows: DataFrame, unique: DataFrame, keys: Sequence[str], row_id: Column,
                  n_column: str, salts: int | None = None, hot_rows: int = 20_000) -> DataFrame:
    """Inner join of many ``rows`` with one row per key in ``unique``.

    ``unique`` tells with ``n_column`` how many rows its key has. Keys with more
    than ``hot_rows`` rows and more than a ten-thousandth of all rows are hot, so
    there are fewer than 10,000 of them whatever the data. A hot key is repeated in
    ``unique`` once for every so many of its rows (or ``salts`` times), which makes
    fewer than 20,000 repetitions in all, and its rows take a salt from ``row_id``;
    cold keys use salt 0 on both sides. The rows learn whether their key is hot, and
    its salts, from a broadcast of the hot keys. ``unique`` is read twice: pass a table, not a plan.
    """
    total, most = unique.agg(F.sum(n_column), F.max(n_column)).first()
    limit = max(hot_rows, (total or 0) // 10_000)
    if (most or 0) <= limit:
        return rows.join(unique, list(keys), "inner")
    count = (F.lit(salts) if salts else F.ceil(F.col(n_column) / limit)).cast("int")
    hot = unique.filter(F.col(n_column) > limit).select(*keys, count.alias("_hot"))
    marked = rows.join(F.broadcast(hot), list(keys), "left")
    marked = marked.withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(row_id), F.col("_hot")).cast("int")).otherwise(0)
    ).drop("_hot")
    spread = unique.withColumn(
        "_salt", F.explode(F.when(F.col(n_column) > limit, F.sequence(F.lit(0), count - 1)).otherwise(F.array(F.lit(0)))))
    return marked.join(spread, [*keys, "_salt"], "inner").drop("_salt")
