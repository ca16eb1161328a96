"""Corpus-relative scoring: statistics, repositories, copies, authors, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import scoring as s
from corpusmill.functions.text import owner_of
from corpusmill.operators.stats import quantile_boundaries, unpivot
from corpusmill.runtime import materialise

REPO_METRICS = ("stars", "forks", "subscribers", "open_issues", "size_kb", "contributors", "releases", "skill_count")


def listed(column: str) -> Column:
    """Length of a JSON array in text, 0 if there is none."""
    return F.greatest(F.coalesce(F.size(F.from_json(column, "array<string>")), F.lit(0)), F.lit(0))


def corpus_values(skills: DataFrame, repos: DataFrame, now: Column) -> DataFrame:
    """(metric, v): what the corpus statistics are about; archived and disabled repositories and invalid documents don't count."""
    live = repos.filter(~F.coalesce("archived", F.lit(False)) & ~F.coalesce("disabled", F.lit(False)))
    per_day = F.col("stars") / s.at_least(s.days_since(F.col("created_at"), now), 30.0)
    one = unpivot(live, {**{m: F.col(m) for m in REPO_METRICS}, "stars_per_day": per_day})
    two = unpivot(skills.filter("valid = 1"), {"body_len": F.col("body_len"), "resource_count": listed("resources")})
    return one.unionByName(two)


def boundary_map(boundaries: DataFrame) -> DataFrame:
    """One row ``_q``: metric -> boundaries. A few metrics of 101 numbers, whatever the corpus."""
    return boundaries.agg(F.map_from_entries(F.collect_list(F.struct("metric", "quantiles"))).alias("_q"))


def q(metric: str) -> Column:
    """Boundaries of a metric out of the joined map; null if the metric has none."""
    return F.try_element_at(F.col("_q"), F.lit(metric))


def score_repos(repos: DataFrame, bounds: DataFrame, now: Column, w: s.Weights = s.Weights()) -> DataFrame:
    """Repositories with ``repo_base``, ``repo_trust`` and ``new_score`` (0..100)."""
    rows = repos.crossJoin(F.broadcast(bounds))
    rows = rows.withColumn("repo_base", s.repo_base(s.repo_parts(now, q, w, F.col("released_at") if "released_at" in rows.columns else None), w)).withColumn("repo_trust", s.trust(w))
    return rows.withColumn("new_score", F.round(100.0 * F.col("repo_base") * F.col("repo_trust"), 2)).drop("_q")


def copy_counts(skills: DataFrame) -> DataFrame:
    """(content_hash, copies, owners): rows and distinct owners per non-empty hash."""
    named = skills.filter("content_hash <> ''")
    return named.groupBy("content_hash").agg(F.count("*").alias("copies"), F.count_distinct(owner_of(F.col("repo"))).alias("owners"))


def name_counts(skills: DataFrame) -> DataFrame:
    """(name, same_name): in how many repositories a name occurs."""
    return skills.filter("name <> ''").groupBy("name").agg(F.count_distinct("repo").alias("same_name"))


def craft(skills: DataFrame, bounds: DataFrame) -> DataFrame:
    """Documents with ``craft`` (0..1)."""
    return skills.crossJoin(F.broadcast(bounds)).withColumn("craft", s.blend(s.craft_parts(q))).drop("_q")


def author_profiles(skills: DataFrame, scored_repos: DataFrame) -> DataFrame:
    """One row an author. skills: with craft and copies; scored_repos: with new_score.

    The median is exact, from merged (author, craft) counts, so an author with a
    third of all documents costs distinct values, not rows.
    """
    per_repo = scored_repos.groupBy(F.col("owner").alias("login")).agg(
        F.count("*").alias("repos"), F.count_if(F.col("skill_count") > 0).alias("skill_repos"),
        F.sum(F.coalesce("stars", F.lit(0))).alias("total_stars"), F.sum(F.coalesce("forks", F.lit(0))).alias("total_forks"),
        F.max(F.coalesce("new_score", F.lit(0.0))).alias("best_repo_score"),
        F.avg(F.when(F.coalesce(F.col("license") != "", F.lit(False)), 1.0).otherwise(0.0)).alias("licensed_rate"),
        F.avg(F.when(F.coalesce(F.trim("description") != "", F.lit(False)), 1.0).otherwise(0.0)).alias("described_rate"),
        F.min("created_at").alias("first_repo_at"), F.max("pushed_at").alias("last_push_at"))
    merged = skills.groupBy(owner_of(F.col("repo")).alias("login"), "craft").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("copies", F.lit(1)) <= 1).alias("o"))
    per_skill = merged.groupBy("login").agg(F.sum("n").alias("skills"), F.sum("o").alias("original_skills"),
                                            F.expr("percentile(craft, 0.5D, n)").alias("median_craft"))
    joined = per_repo.join(per_skill, "login", "left").filter("skill_repos > 0 OR skills IS NOT NULL")
    return joined.withColumns({"skills": F.coalesce("skills", F.lit(0)), "original_skills": F.coalesce("original_skills", F.lit(0))})


def author_bounds(profiles: DataFrame) -> DataFrame:
    """Boundaries of the author metrics."""
    rows = profiles.filter("skills > 0")
    return quantile_boundaries(unpivot(rows, {"author_stars": F.col("total_stars"), "author_skills": F.col("skills"), "author_followers": F.col("followers")}))


def score_authors(profiles: DataFrame, bounds: DataFrame, now: Column) -> DataFrame:
    """Profiles with ``author_score`` (0..100)."""
    rows = profiles.crossJoin(F.broadcast(bounds))
    return rows.withColumn("author_score", F.round(100.0 * s.blend(s.author_parts(now, q)), 2)).drop("_q")


def recompute(skills: DataFrame, repos: DataFrame, now: Column, followers: DataFrame | None = None, w: s.Weights = s.Weights()) -> dict[str, DataFrame]:
    """All scores in dependency order: statistics, repositories, copies, authors, documents.

    skills, repos: current rows, skills without texts. followers: (login, followers) if known. Documents
    whose repository is unknown are not scored. Returns boundaries, repos, authors
    and skills; texts are never read.
    """
    skills, repos = materialise(skills, "skills"), materialise(repos, "repos")
    boundaries = materialise(quantile_boundaries(corpus_values(skills, repos, now)), "boundaries")
    bounds = boundary_map(boundaries)
    scored = materialise(score_repos(repos, bounds, now, w), "repos-scored")
    copies, names = copy_counts(skills), name_counts(skills)
    made = materialise(craft(skills.join(copies, "content_hash", "left").join(names, "name", "left"), bounds), "crafted")
    profiles = author_profiles(made, scored)
    profiles = profiles.join(followers, "login", "left") if followers is not None else profiles.withColumn("followers", F.lit(None).cast("bigint"))
    profiles = materialise(profiles, "profiles")
    authors = score_authors(profiles, boundary_map(author_bounds(profiles)), now)
    by_repo = scored.select(F.col("full_name").alias("repo"), "repo_trust", F.col("new_score").alias("repo_score"), F.col("skill_count").alias("_in_repo"))
    joined = made.join(by_repo, "repo").join(authors.select(F.col("login").alias("_login"), "author_score"), owner_of(F.col("repo")) == F.col("_login"), "left")
    base = s.blend([("repo_standing", F.col("repo_score") / 100.0, w.repo_standing), ("author_standing", F.col("author_score") / 100.0, w.author_standing),
                    ("craft", F.col("craft"), w.craft),
                    ("distinctiveness", s.blend(s.distinct_parts(F.col("copies"), F.col("owners"), F.col("same_name"), F.col("_in_repo"))), w.distinctiveness)])
    level = F.coalesce("risk_level", F.lit("none")) if "risk_level" in joined.columns else F.lit("none")
    out = joined.withColumn("base", base).withColumn("new_score", F.round(100.0 * F.col("base") * F.col("repo_trust") * s.safety_factor(level), 2))
    return {"boundaries": boundaries, "repos": scored, "authors": authors, "skills": out.drop("_login", "_in_repo")}


def explain(ranked: dict[str, DataFrame], skill_id: int) -> DataFrame:
    """One document's score with the parts it comes from."""
    return ranked["skills"].filter(F.col("id") == skill_id).select(
        "id", "repo", "name", "new_score", F.struct("repo_score", "author_score", "craft", "copies", "owners", "same_name", "repo_trust", "base").alias("parts"))
