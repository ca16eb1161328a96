"""Search end to end: match, filter, rank, fuse, collapse, diversify."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import compile_query, owner_of, snippet_of
from corpusmill.operators import filters as fl
from corpusmill.operators import fusion
from corpusmill.operators import search as sr
from corpusmill.operators.latest import current_rows, latest
from corpusmill.runtime import materialise

DETAIL = ("repo", "path", "name", "description", "source_kind", "license", "score", "content_hash", "risk_level", "valid")
REPO_DETAIL = ("stars", "language", "pushed_at", "owner_type", "is_fork", "archived")


def joined(skills: DataFrame, repos: DataFrame) -> DataFrame:
    """Documents with the columns of their repository that filters and results need."""
    r = repos.select(F.col("full_name").alias("repo"), F.col("license").alias("repo_license"), *REPO_DETAIL)
    return skills.join(r, "repo")


def matched(skills: DataFrame, query: str, at: str | None) -> tuple[DataFrame, int]:
    """((id, f, dl, detail...), number of terms) by a scan of the texts.

    at: with it ``skills`` may hold several states of an id; hits are counted where
        the texts lie and only the latest state's are kept, so texts don't travel.
    """
    keep = [c for c in DETAIL if c in skills.columns]
    rows, n = sr.match_scan(skills, "id", query, [*keep, *([at] if at else [])])
    return (latest(rows, "id", at, [*keep, "f", "dl"]) if at else rows), n


def candidates(skills: DataFrame, repos: DataFrame, query: str, filters: Mapping[str, Any] | None = None, now: Column | None = None,
               index: tuple[DataFrame, DataFrame] | None = None, at: str | None = None) -> tuple[DataFrame, int]:
    """Matching documents with ``f``, ``dl``, ``bm25`` and detail, and the number of query terms.

    With an index only its postings of the query's terms are read; without one the
    texts are scanned once. Term statistics are those of all documents either way.
    """
    if index is not None:
        postings, stats = index
        hits, n = sr.match_index(postings, query)
        rows = stats.join(hits, "id", "left").withColumn("f", F.coalesce("f", F.array(*[F.lit(0.0)] * max(n, 1))))
        rows = sr.bm25(rows, n).filter(sr.matches(False)).join(details(skills, at), "id")
    else:
        rows, n = matched(skills, query, at)
        rows = materialise(rows, "matches")  # narrow: no text
        rows = sr.bm25(rows, n).filter(sr.matches(False))
    rows = joined(rows, repos)
    return rows.filter(fl.request_filter(filters or {}, rows.columns, now)), n


@dataclass(frozen=True)
class Serving:
    """What a search reads: postings sorted by term, documents without texts, and the corpus's size and average length."""

    postings: DataFrame
    documents: DataFrame
    corpus: tuple[int, float]

    def candidates(self, query: str, filters: Mapping[str, Any] | None = None, now: Column | None = None) -> tuple[DataFrame, int]:
        """Like :func:`candidates`, from the documents that match; others aren't read beyond their ids."""
        hits, n = sr.match_index(self.postings, query)
        rows = sr.bm25(hits.join(self.documents, "id"), n, self.corpus).filter(sr.matches(False) & F.col("_repo"))
        return rows.filter(fl.request_filter(filters or {}, rows.columns, now)), n


def build_serving(skills: DataFrame, repos: DataFrame, at: str | None, path: str) -> None:
    """Write the tables of :class:`Serving` below ``path``: once per state of the corpus, read by every search."""
    keep = [c for c in DETAIL if c in skills.columns]
    current = current_rows(skills, "id", at, [*dict.fromkeys([*keep, *sr.FIELD_WEIGHTS])]) if at else skills
    sr.write_index(current, "id", path)
    stats = current.sparkSession.read.parquet(f"{path}/stats")
    r = repos.select(F.col("full_name").alias("repo"), F.col("license").alias("repo_license"), *REPO_DETAIL, F.lit(True).alias("_known"))
    rows = current.select("id", *keep).join(stats, "id").join(r, "repo", "left").withColumn("_repo", F.coalesce("_known", F.lit(False))).drop("_known")
    rows.write.mode("overwrite").parquet(f"{path}/documents")
    stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg")).write.mode("overwrite").parquet(f"{path}/corpus")


def open_serving(spark: SparkSession, path: str) -> Serving:
    """The tables that :func:`build_serving` wrote."""
    size = spark.read.parquet(f"{path}/corpus").first()
    return Serving(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"), (size["n"], size["avg"]))


def details(skills: DataFrame, at: str | None) -> DataFrame:
    """Current documents without their texts."""
    keep = [c for c in DETAIL if c in skills.columns]
    return latest(skills, "id", at, keep) if at else skills.select("id", *keep)


def best_of(rows: DataFrame, score: str, k: int, max_per_repo: int | None, cut_first: bool) -> DataFrame:
    """The best ``k`` rows by ``score`` with ``pos`` and the ``duplicates`` they stand for.

    Copies among all rows are collapsed before the cut, and rows beyond
    ``max_per_repo`` of their repo queue behind those of others.
    cut_first: the best ``k`` are cut from all rows, copies included, as the reference does;
        copies and a dominant repo can then fill the places. For parity only.
    """
    order = [F.col(score).desc(), F.col("id")]
    if cut_first:
        return fusion.positions(sr.top_k(rows, score, k), order, bounded=True)
    once = fusion.collapse_duplicates(rows, "content_hash", "score", "id")
    if max_per_repo:
        return fusion.diversified_top(once, "repo", order, max_per_repo, k)
    return fusion.positions(sr.top_k(once, score, k), order, bounded=True)


def search(skills: DataFrame, repos: DataFrame, query: str, *, limit: int = 20, filters: Mapping[str, Any] | None = None, now: Column | None = None,
           vectors: tuple[DataFrame, Sequence[float]] | None = None, quality_weight: float = 0.5, max_per_repo: int | None = 3,
           authors: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None, snippets: bool = False,
           at: str | None = None, cut_first: bool = False, serving: Serving | None = None) -> DataFrame:
    """The ``limit`` best documents for a text: (pos, id, rank, matched_by, duplicates, detail...).

    vectors: ((id, embedding) rows, query vector) adds a channel of neighbours.
    Matches of all terms are ranked, or of any term if these are too few. Copies
    are collapsed over all matches before each channel's best ``limit * 5`` are
    fused; quality reorders what was found. cut_first: see :func:`best_of`.
    serving: tables of :func:`build_serving`, of the same state of ``skills``; only
        postings and documents of the query's terms are read then.
    """
    rows, _ = serving.candidates(query, filters, now) if serving else candidates(skills, repos, query, filters, now, index, at)
    kw = materialise(best_of(sr.choose(rows), "bm25", limit * 5, max_per_repo, cut_first), "keyword").coalesce(1)  # a page's worth, which is ranked in one task
    channels = {"keyword": kw.select("id", "pos")}
    counted = [] if cut_first else ["duplicates"]
    found = kw.select("id", *[c for c in rows.columns if c in (*DETAIL, "stars")], *counted)
    if vectors is not None:
        vec_rows, q = vectors
        near = sr.vector_top_k(vec_rows, "id", "embedding", q, limit * 5 if cut_first else None)
        known = joined(details(skills, at), repos)
        near = near.join(known.filter(fl.request_filter(filters or {}, known.columns, now)), "id")
        near = materialise(best_of(near, "similarity", limit * 5, max_per_repo, cut_first), "near").coalesce(1)
        channels["vector"] = near.select("id", "pos")
        found = fusion.merge_channels(found, near.select(*found.columns), "id")
    stood_for = found.select("id", F.col("duplicates").alias("_copies")) if counted else None
    once = fusion.collapse_duplicates(found.drop("duplicates"), "content_hash", "score", "id")
    if stood_for is not None:
        once = once.join(stood_for, "id").withColumn("duplicates", F.greatest("duplicates", "_copies")).drop("_copies")
    ranked = fusion.fuse(channels, "id", {"quality": quality_weight}, quality=(once, "score"), bounded=True).join(once, "id")
    order = [F.col("rank").desc(), F.col("id").asc()]
    listed = fusion.diversify(ranked, "repo", order, max_per_repo, bounded=True) if max_per_repo else fusion.positions(ranked, order, bounded=True)
    out = listed.filter(F.col("pos") <= limit)
    if snippets:
        bodies = skills.join(out.select("id"), "id", "left_semi")  # the texts of one page
        bodies = latest(bodies, "id", at, ["body"]) if at else bodies
        out = out.join(bodies.select("id", snippet_of(compile_query(query)[0])("body").alias("snippet")), "id")
    if authors is not None:
        out = out.join(authors.select(F.col("login").alias("_l"), "author_score"), owner_of(F.col("repo")) == F.col("_l"), "left").drop("_l")
    return out


def browse(skills: DataFrame, repos: DataFrame, *, sort: str = "quality", limit: int = 20, offset: int = 0, filters: Mapping[str, Any] | None = None,
           now: Column | None = None, max_per_repo: int = 3) -> DataFrame:
    """A page of documents without a query: by quality, stars, newest or name; copies collapsed, repositories diversified.

    Copies are collapsed and rows ranked within their repos before anything is cut, so pages are exact and fit together.
    """
    rows = joined(skills.select("id", "first_seen", *[c for c in (*DETAIL, "category", "subcategory") if c in skills.columns]), repos)
    rows = rows.filter(fl.request_filter(filters or {}, rows.columns, now))
    once = fusion.collapse_duplicates(rows, "content_hash", "score", "id")
    order = {"quality": [F.col("score").desc_nulls_last(), F.col("stars").desc_nulls_last()], "stars": [F.col("stars").desc_nulls_last()],
             "newest": [F.col("first_seen").desc_nulls_last()], "name": [F.col("name").asc_nulls_last()]}[sort]
    order = [*order, F.col("id").asc()]
    placed = fusion.diversified_top(once, "repo", order, max_per_repo, limit + offset)
    return placed.filter(F.col("pos").between(offset + 1, offset + limit))


def count_matches(skills: DataFrame, repos: DataFrame, query: str, filters: Mapping[str, Any] | None = None, now: Column | None = None,
                  at: str | None = None) -> DataFrame:
    """One row: how many documents match (all terms if enough, else any)."""
    rows = joined(matched(skills, query, at)[0], repos)
    return sr.count_matches(rows.filter(fl.request_filter(filters or {}, rows.columns, now)))


def facet_counts(skills: DataFrame, repos: DataFrame, query: str, filters: Mapping[str, Any] | None = None, top: int = 10, now: Column | None = None,
                 at: str | None = None) -> DataFrame:
    """(facet, value, n) of the matching documents."""
    rows = joined(matched(skills, query, at)[0], repos)
    hits = rows.filter(sr.matches(False)).filter(fl.request_filter(filters or {}, rows.columns, now))
    return sr.facets(hits.withColumn("kind", F.col("source_kind")), ["kind", "license", "language"], top)
