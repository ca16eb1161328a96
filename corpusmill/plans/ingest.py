"""From files to rows of the corpus: parse, assess whole, then cut what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import classify_path, content_hash, parse_skills, truncated
from corpusmill.operators.assess import assess
from corpusmill.sources.files import owned_files

STORED_BODY = 4000


def with_resources(rows: DataFrame) -> DataFrame:
    """Documents of (repo, path, text) with ``resources``, the paths, and ``bundled``, the texts of the files in their folder.

    A file belongs to the document whose folder is its longest prefix. What is
    gathered for a document are files of its own folder.
    """
    is_document = F.lower(F.substring_index("path", "/", -1)) == "skill.md"
    documents, files = rows.filter(is_document), rows.filter(~is_document)
    owned = owned_files(documents, files).join(files.select("repo", F.col("path").alias("file"), F.col("text").alias("_t")), ["repo", "file"])
    each = owned.groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct("file", "_t"))).alias("_f"))
    joined = documents.join(each, ["repo", "path"], "left")
    return joined.select(*rows.columns, F.coalesce(F.col("_f.file"), F.array().cast("array<string>")).alias("resources"), F.array_join("_f._t", "\n").alias("bundled"))


def skills_of(rows: DataFrame, at: Column, body_limit: int = STORED_BODY) -> DataFrame:
    """Rows of the table of documents from (repo, path, text) of an archive or a tree.

    Verdicts and hashes are made from whole texts, with bundled files and all front
    matter; only then bodies are cut to ``body_limit``, which is what is stored.
    """
    documents = parse_skills(with_resources(rows), "text")
    p = lambda c: F.col(f"parsed.{c}")
    extra = F.concat_ws("\n", p("metadata"), p("extra"))
    judged = assess(documents, {"name": p("name"), "description": p("description"), "body": p("body"), "path": F.col("path"), "metadata": extra,
                                "resources": F.col("bundled"), "tools": p("allowed_tools")}, keep=["repo", "path", "text", "resources", "parsed"])
    files = F.array_sort(F.array_union("resources", p("resources")))
    return judged.select(
        "repo", "path", p("name").alias("name"), p("description").alias("description"), truncated(p("body"), body_limit).alias("body"), p("heading").alias("heading"),
        p("version").alias("version"), p("license").alias("license"), F.to_json(p("allowed_tools")).alias("allowed_tools"), p("metadata").alias("metadata"),
        F.to_json(files).alias("resources"), classify_path(F.col("path")).alias("source_kind"), content_hash(F.col("text")).alias("content_hash"), p("body_len").alias("body_len"),
        p("valid").cast("int").alias("valid"), F.array_join(p("problems"), "; ").alias("invalid_reason"), F.array_join(p("warnings"), "; ").alias("warnings"),
        at.alias("last_seen"), F.col("verdict.level").alias("risk_level"), F.col("verdict").alias("verdict"))
