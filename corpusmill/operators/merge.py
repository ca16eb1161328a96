"""Upserts, mirrors and queues as joins that yield a new snapshot."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranks import global_rank


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Full outer merge of two snapshots with unique keys, column by column.

    By default a new value wins unless it is null. ``rules`` names other ways:
    functions of (old, new), applied where a key is in both. Columns that only one
    side has come from it.
    """
    rules = rules or {}
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    joined = old.withColumn("_in", F.lit(1)).alias("o").join(
        new.withColumn("_in", F.lit(1)).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    both = F.col("o._in").isNotNull() & F.col("n._in").isNotNull()
    out = []
    for c in columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}").alias(c))
        elif c in rules:
            o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
            out.append(F.when(both, rules[c](o, n)).otherwise(F.coalesce(n, o)).alias(c))
        else:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


# How two states of a field meet; for use as rules of an upsert.
def keep_old(old: Column, new: Column) -> Column:
    """The first value known."""
    return F.coalesce(old, new)


def keep_new(old: Column, new: Column) -> Column:
    """The new value, even if null."""
    return new


def keep_larger(old: Column, new: Column) -> Column:
    """The larger value."""
    return F.greatest(old, new)


def never_to_zero(old: Column, new: Column) -> Column:
    """A new score of 0 or null doesn't wipe out an old one."""
    return F.when(F.coalesce(new, F.lit(0)) > 0, new).otherwise(old)


def while_same(hash_name: str) -> Callable[[Column, Column], Column]:
    """Keep the old value only while the content is the same; a changed one clears it."""
    return lambda old, new: F.when(F.col(f"o.{hash_name}").eqNullSafe(F.col(f"n.{hash_name}")), F.coalesce(new, old)).otherwise(new)


REPO_RULES = {"discovered_via": keep_old, "first_seen": keep_old}


def skill_rules(risk_columns: Sequence[str] = ("risk_level", "risk_action", "risk_confidence", "risk_detail")) -> dict:
    """Rules for document rows: scores never fall to 0, verdicts hold only for the same content."""
    return {"score": never_to_zero, "first_seen": keep_old, **{c: while_same("content_hash") for c in risk_columns}}


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those of ``new`` whose key it lacks, one row each."""
    extra = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(extra, allowMissingColumns=True)


def delete_missing(old: DataFrame, seen: DataFrame, keys: Sequence[str], scope: str) -> DataFrame:
    """``old`` without rows that ``seen`` lacks, in those scopes that ``seen`` covers."""
    covered = seen.select(scope).distinct().withColumn("_covered", F.lit(True))
    there = seen.select(*keys).distinct().withColumn("_there", F.lit(True))
    joined = old.join(covered, scope, "left").join(there, list(keys), "left")
    return joined.filter(F.col("_covered").isNull() | F.col("_there").isNotNull()).select(*old.columns)


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Queue with requests added: per name the highest priority, the first time and the reason of that time."""
    both = queue.unionByName(new, allowMissingColumns=True)
    return both.groupBy("full_name").agg(
        F.max("priority").alias("priority"), F.min_by("reason", F.struct("enqueued_at", "reason")).alias("reason"),
        F.min("enqueued_at").alias("enqueued_at"), F.max(F.coalesce("attempts", F.lit(0))).alias("attempts"))


def take(queue: DataFrame, repos: DataFrame, k: int, by_score: bool = True, most_attempts: int = 4, cutoff: Column | None = None) -> DataFrame:
    """The next ``k`` requests: few attempts, not crawled since ``cutoff``, best score or first come first."""
    joined = queue.join(repos.select("full_name", "repo_score", "last_crawled"), "full_name", "left")
    open_ = joined.filter(F.coalesce("attempts", F.lit(0)) < most_attempts)
    if cutoff is not None:
        open_ = open_.filter(F.col("last_crawled").isNull() | (F.col("last_crawled") < cutoff))
    score = F.coalesce("repo_score", F.lit(0.0))
    order = [score.desc(), F.col("priority").desc(), F.col("enqueued_at")] if by_score else [F.col("priority").desc(), F.col("enqueued_at")]
    return open_.orderBy(*order, F.col("full_name")).limit(k)


def swept(queue: DataFrame, repos: DataFrame) -> DataFrame:
    """The queue with ``place`` (from 0), how a sweep goes through it: by priority, then by score, then by name."""
    rows = queue.join(repos.select("full_name", "repo_score"), "full_name", "left")
    return global_rank(rows, [], [F.col("priority").desc(), F.coalesce("repo_score", F.lit(0.0)).desc(), F.col("full_name")], "place")


def mark_repos(repos: DataFrame, done: DataFrame) -> DataFrame:
    """Repositories with the crawl that ``done`` (full_name, crawled_at, error, tree_sha) reports; a failed one keeps its tree."""
    d = done.select("full_name", "crawled_at", "error", F.col("tree_sha").alias("_tree"))
    joined = repos.join(d, "full_name", "left")
    said = F.col("crawled_at").isNotNull()
    return (joined.withColumn("last_crawled", F.coalesce("crawled_at", "last_crawled"))
            .withColumn("last_error", F.when(said, F.col("error")).otherwise(F.col("last_error")))
            .withColumn("tree_sha", F.when(said & F.col("error").isNull(), F.coalesce("_tree", "tree_sha")).otherwise(F.col("tree_sha")))
            .select(*repos.columns))


def touch(queue: DataFrame, taken: DataFrame) -> DataFrame:
    """The queue with one attempt more for the requests taken."""
    marks = taken.select("full_name").distinct().withColumn("_t", F.lit(1))
    return queue.join(marks, "full_name", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + F.coalesce("_t", F.lit(0))).drop("_t")


def dequeue(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without what is done."""
    return queue.join(done.select("full_name"), "full_name", "left_anti")


def changed(new: DataFrame, old: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Rows of ``new`` that are unknown or whose ``mark`` (a content hash) differs from the old one."""
    known = old.select(*keys, F.col(mark).alias("_old"), F.lit(True).alias("_known"))
    joined = new.join(known, list(keys), "left")
    return joined.filter(F.col("_known").isNull() | ~F.col(mark).eqNullSafe(F.col("_old"))).drop("_old", "_known")


def spread_to_copies(rows: DataFrame, decisions: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Decisions made once per content, joined to every row that holds it; others keep what they have."""
    d = decisions.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_d_{c}") for c in columns])
    joined = rows.join(d, F.col(key) == F.col("_k"), "left")
    have = set(rows.columns)
    out = [F.coalesce(F.col(f"_d_{c}"), F.col(c) if c in have else F.lit(None)).alias(c) for c in columns]
    return joined.select(*[c for c in rows.columns if c not in columns], *out)


def get(kv: DataFrame, key: str, default: str | None = None) -> str | None:
    """The value of one entry of a key-value table."""
    row = kv.filter(F.col("key") == key).select("value").first()
    return row[0] if row else default


def put(kv: DataFrame, key: str, value: str, at: Column) -> DataFrame:
    """A key-value table with one entry set."""
    new = kv.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), at.alias("computed_at"))
    return kv.filter(F.col("key") != key).unionByName(new)
