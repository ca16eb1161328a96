"""Schemas of the tables, and reading older files with fewer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SKILLS = (
    "id bigint, repo string, path string, name string, description string, body string, heading string, version string, license string, "
    "allowed_tools string, metadata string, resources string, source_kind string, blob_sha string, content_hash string, body_len bigint, "
    "score double, valid int, invalid_reason string, warnings string, first_seen timestamp, last_seen timestamp, category string, risk_level string")
REPOS = (
    "full_name string, owner string, name string, owner_type string, default_branch string, description string, homepage string, language string, "
    "stars bigint, forks bigint, subscribers bigint, open_issues bigint, size_kb bigint, license string, topics array<string>, created_at timestamp, "
    "updated_at timestamp, pushed_at timestamp, is_fork boolean, archived boolean, disabled boolean, is_template boolean, has_issues boolean, "
    "has_wiki boolean, has_pages boolean, has_discussions boolean, contributors bigint, releases bigint, tree_sha string, skill_count bigint, "
    "discovered_via string, repo_score double, first_seen timestamp, last_crawled timestamp, last_meta_at timestamp, last_error string, host string")
QUEUE = ("full_name string, priority int, reason string, enqueued_at timestamp, attempts int")
EVENTS = ("type string, repo struct<name:string>, created_at timestamp, actor struct<login:string>")


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with every column of a schema: missing ones null, others cast, extra ones kept behind."""
    schema, have = StructType.fromDDL(ddl), set(df.columns)
    named = [(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return df.select(*named, *[c for c in df.columns if c not in schema.fieldNames()])


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet dataset whose files may have been written with different columns."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), ddl)
