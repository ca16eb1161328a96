"""Building a release: trim, assess, override, cap, index, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import truncated
from corpusmill.operators.assess import override
from corpusmill.operators.search import write_index


def trim(skills: DataFrame, k: int) -> DataFrame:
    """The ``k`` best valid documents that aren't blocked."""
    blocked = F.coalesce(F.col("risk_level") == "critical", F.lit(False))
    return skills.filter((F.col("valid") == 1) & ~blocked).orderBy(F.col("score").desc_nulls_last(), "id").limit(k)


def orphans(repos: DataFrame, skills: DataFrame) -> DataFrame:
    """Repositories none of whose documents is left."""
    return repos.join(skills.select(F.col("repo").alias("full_name")), "full_name", "left_anti")


def build(skills: DataFrame, repos: DataFrame, path: str, keep: int | None = None, decisions: DataFrame | None = None, body_limit: int = 2000) -> None:
    """Write a snapshot: documents (bodies cut after all hashes and verdicts were made), their repositories, the index of the whole texts."""
    chosen = trim(skills, keep) if keep else skills
    if decisions is not None:
        chosen = override(chosen.withColumn("action", F.lit(None).cast("string")), decisions)
    short = chosen.withColumn("body", truncated(F.col("body"), body_limit))
    short.write.mode("overwrite").parquet(f"{path}/skills")
    done = short.sparkSession.read.parquet(f"{path}/skills")
    repos.join(done.select(F.col("repo").alias("full_name")), "full_name", "left_semi").write.mode("overwrite").parquet(f"{path}/repos")
    write_index(chosen, "id", f"{path}/index")


def audit_sample(skills: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """``k`` rows per level for a person to look at, undecided contents first seen once."""
    from corpusmill.operators.stats import stratified_sample

    once = skills.groupBy("content_hash").agg(F.min_by(F.struct("id", "repo", "risk_level"), "id").alias("_r")).select("content_hash", "_r.*")
    return stratified_sample(once, "risk_level", "id", k, seed)


def severity(level: Column) -> Column:
    """Sort key: the most severe first."""
    return F.when(level == "critical", 0).when(level == "high", 1).when(level == "medium", 2).when(level == "low", 3).otherwise(4)
