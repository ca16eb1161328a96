"""Two-level classification by weighted patterns.

The taxonomy is data: rows (category, subcategory, pattern); a null subcategory
makes a pattern the category's own. Everything stays in the JVM: one ``rlike`` per
field and group of patterns inside one projection, and one per pattern only where that
matches; no join and no UDF.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import spread

# What a match in each field counts, how many a description may contribute.
FIELD_WEIGHTS = {"name": 3.0, "description": 1.0, "path": 1.5, "topics": 2.0}
MAX_DESCRIPTION = 2
SECONDARY = 0.55
UNKNOWN = "uncategorised"

# A small taxonomy of our own for tables without one; callers pass theirs.
DEFAULT = [
    ("data", "tables", "table"), ("data", "tables", "spreadsheet"), ("data", "pipelines", "pipeline"), ("data", None, "dataset"), ("data", None, "query"),
    ("testing", "unit", "fixture"), ("testing", "quality", "validat"), ("testing", None, "test"), ("testing", None, "baseline"),
    ("documents", "writing", "report"), ("documents", "formats", "pdf"), ("documents", None, "document"), ("documents", None, "summar"),
    ("devops", "deploy", "deploy"), ("devops", "monitor", "monitor"), ("devops", None, "container"), ("devops", None, "cluster"),
    ("design", "layout", "layout"), ("design", None, "diagram"), ("design", None, "style"),
    ("security", "review", "audit"), ("security", None, "secret"), ("security", None, "vault"),
    ("research", "sources", "citation"), ("research", None, "survey"), ("research", None, "notebook"),
    ("writing", None, "draft"), ("writing", None, "translat"), ("writing", "editing", "rewrite"),
]


def anchored(pattern: str) -> str:
    """Regular expression of a pattern: hand-anchored ones as they are, long words as prefixes, short ones whole."""
    if pattern.startswith(("\\b", "(")):
        return f"(?iu){pattern}"
    return f"(?iu)\\b{re.escape(pattern)}" + ("" if len(pattern) >= 6 else "\\b")


def _total(patterns: Sequence[str], fields: Mapping[str, Column], idf: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    any_of = "(?iu)" + "|".join(anchored(p).removeprefix("(?iu)") for p in patterns)
    for name, text in fields.items():
        w = FIELD_WEIGHTS.get(name, 1.0)
        hits = [F.when(text.rlike(anchored(p)), F.lit(idf.get(p, 1.0) * w)).otherwise(0.0) for p in patterns]
        if not hits:
            continue
        values = F.array(*hits)
        if name == "description":
            values = F.slice(F.sort_array(values, asc=False), 1, MAX_DESCRIPTION)
        counted = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        total = total + F.when(text.rlike(any_of), counted).otherwise(0.0)  # most texts match none, by one expression
    return total


def classify(df: DataFrame, fields: Mapping[str, Column], taxonomy: Sequence[tuple[str, str | None, str]] = tuple(DEFAULT),
             idf: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``category``, ``subcategory`` and ``secondary`` (up to two, at least 55 % of the best).

    fields: name, description, path, topics as text columns; null matches nothing.
    Among equal scores the category (and subcategory) named first in the taxonomy
    wins. Without a match the category is ``uncategorised``.
    """
    idf = idf or {}
    order = list(dict.fromkeys(c for c, _, _ in taxonomy))
    texts = {n: F.coalesce(c, F.lit("")) for n, c in fields.items()}
    own = {c: [p for k, _, p in taxonomy if k == c] for c in order}
    scored = spread(df).withColumn("_scores", F.array(*[
        F.struct(_total(own[c], texts, idf).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(order)]))
    best = F.array_max("_scores")
    scored = scored.withColumn("_best", best).withColumn("category", F.when(F.col("_best.s") > 0, F.col("_best.c")).otherwise(UNKNOWN))
    sub = F.lit(None).cast("string")
    for c in order:
        names = list(dict.fromkeys(s for k, s, _ in taxonomy if k == c and s))
        if names:
            each = F.array(*[F.struct(_total([p for k, s, p in taxonomy if k == c and s == n], texts, idf).alias("s"), F.lit(-i).alias("i"),
                                      F.lit(n).alias("c")) for i, n in enumerate(names)])
            top = F.array_max(each)
            sub = F.when((F.col("category") == c) & (top["s"] > 0), top["c"]).otherwise(sub)
    near = F.filter(F.sort_array("_scores", asc=False), lambda x: (x["c"] != F.col("_best.c")) & (x["s"] >= F.col("_best.s") * SECONDARY) & (F.col("_best.s") > 0))
    return scored.withColumn("subcategory", sub).withColumn(
        "secondary", F.slice(F.transform(near, lambda x: x["c"]), 1, 2)).drop("_scores", "_best")


def catalogue(df: DataFrame) -> DataFrame:
    """(category, total, subs): the tree as one row a category, largest first; subs is JSON."""
    counts = df.groupBy("category", "subcategory").agg(F.count("*").alias("n"))
    tree = counts.groupBy("category").agg(
        F.sum("n").alias("total"),
        F.to_json(F.transform(F.sort_array(F.collect_list(F.when(F.col("subcategory").isNotNull(), F.struct((-F.col("n")).alias("o"), F.col("subcategory").alias("id"))))),
                              lambda x: F.struct(x["id"].alias("id"), (-x["o"]).alias("n")))).alias("subs"))
    return tree.orderBy(F.col("total").desc(), "category")
