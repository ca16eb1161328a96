"""Scores relative to a corpus: pure Column arithmetic, no UDF.

A component without a value says nothing: its weight goes to the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = tuple[str, Column, float]


@dataclass(frozen=True)
class Weights:
    """Weights and factors of the composite scores; any can be replaced."""

    popularity: float = 0.22
    momentum: float = 0.14
    maintenance: float = 0.16
    authority: float = 0.13
    repo_standing: float = 0.32
    author_standing: float = 0.16
    craft: float = 0.33
    distinctiveness: float = 0.19
    push_halflife: float = 120.0
    release_halflife: float = 240.0
    archived_factor: float = 0.55
    fork_factor: float = 0.45
    disabled_factor: float = 0.25
    template_factor: float = 0.90
    unlicensed_factor: float = 0.93
    dump_threshold: int = 500
    dump_factor: float = 0.70
    anomaly_min_stars: int = 500
    anomaly_fork_ratio: float = 0.012
    anomaly_factor: float = 0.72


# What a safety level leaves of a score.
SAFETY_FACTORS = {"low": 0.95, "medium": 0.75, "high": 0.40, "critical": 0.0}


def at_least(value: Column, low: float) -> Column:
    """The value, or ``low`` if it is less; null stays null (``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def at_most(value: Column, high: float) -> Column:
    """The value, or ``high`` if it is more; null stays null."""
    return F.when(value.isNotNull(), F.least(value, F.lit(high)))


def days_since(at: Column, now: Column) -> Column:
    """Days between ``at`` and ``now``, at least 0; null stays null."""
    return at_least((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0), 0.0)


def recency(days: Column, halflife: float) -> Column:
    """Exponential decay: 1 now, one half after ``halflife`` days; null stays null."""
    return F.exp(-at_least(days, 0.0) * F.lit(math.log(2) / max(halflife, 1.0)))


def blend(parts: Sequence[Part]) -> Column:
    """Weighted mean of the non-null parts, each cut to 0..1; one half if all are null.

    A fold over an array, so that each part stands in the plan once, however deep
    blends are nested.
    """
    each = F.array(*[F.struct(value.cast("double").alias("v"), F.lit(float(w)).alias("w")) for _, value, w in parts])
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))

    def add(a: Column, x: Column) -> Column:
        cut = F.least(F.greatest(x["v"], F.lit(0.0)), F.lit(1.0))
        there = x["v"].isNotNull()
        return F.struct((a["t"] + F.when(there, cut * x["w"]).otherwise(0.0)).alias("t"), (a["w"] + F.when(there, x["w"]).otherwise(0.0)).alias("w"))

    return F.aggregate(each, start, add, lambda a: F.when(a["w"] == 0.0, F.lit(0.5)).otherwise(a["t"] / a["w"]))


def detail(parts: Sequence[Part]) -> Column:
    """The parts of a blend as a struct, rounded, for explanations."""
    return F.struct(*[F.round(at_most(at_least(v.cast("double"), 0.0), 1.0), 4).alias(n) for n, v, _ in parts])


def places_before(quantiles: Column, holds) -> Column:
    """How many entries of a sorted array ``holds`` is true for, if it is for a beginning of it: bisection over up to 1,023 entries."""
    steps = F.array(*[F.lit(1 << i) for i in range(9, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when(holds(F.get(quantiles, at + n - 1)), at + n).otherwise(at))


def mid_rank(quantiles: Column, value: Column) -> Column:
    """Place of a value in a sorted array of boundaries (at most 1,023), counting equal ones half; null if either is null."""
    v = value.cast("double")
    below, upto = places_before(quantiles, lambda q: q < v), places_before(quantiles, lambda q: q <= v)
    place = (below + upto) / F.lit(2.0) / (F.size(quantiles) - 1)
    return F.when(quantiles.isNotNull() & v.isNotNull(), place)


def repo_parts(now: Column, q, w: Weights = Weights(), released: Column | None = None) -> dict[str, list[Part]]:
    """Components of a repository's score. ``q(metric)`` gives the boundary array of a metric.

    released: time of the last release; where it is unknown its weight goes to the others.
    """
    since_release = days_since(released, now) if released is not None else F.lit(None).cast("double")
    c = F.col
    pct = lambda metric, col: mid_rank(q(metric), col)
    age, pushed = days_since(c("created_at"), now), days_since(c("pushed_at"), now)
    stars = F.coalesce(c("stars"), F.lit(0))
    per_day = stars / at_least(age, 30.0)
    load = pct("open_issues", c("open_issues"))
    flag = lambda cond, yes=1.0, no=0.0: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    filled = lambda col: F.coalesce(F.trim(col) != "", F.lit(False))
    return {
        "popularity": [("stars", pct("stars", c("stars")), 0.60), ("forks", pct("forks", c("forks")), 0.25),
                       ("subscribers", pct("subscribers", c("subscribers")), 0.15)],
        "momentum": [("stars_per_day", pct("stars_per_day", per_day), 0.65), ("push_recency", recency(pushed, w.push_halflife), 0.35)],
        "maintenance": [("push_recency", recency(pushed, w.push_halflife), 0.50),
                        ("release_recency", recency(since_release, w.release_halflife), 0.20),
                        ("release_count", pct("releases", c("releases")), 0.10),
                        ("issues_enabled", flag(F.coalesce(c("has_issues"), F.lit(False))), 0.10),
                        ("issue_load", 1.0 - F.when(load.isNull() | (load == 0.0), F.lit(0.5)).otherwise(load), 0.10)],
        "authority": [("org_owned", flag(F.coalesce(c("owner_type") == "Organization", F.lit(False)), 1.0, 0.35), 0.25),
                      ("licensed", flag(F.coalesce(c("license") != "", F.lit(False))), 0.20),
                      ("described", flag(filled(c("description"))), 0.15),
                      ("topics_curated", F.least(F.coalesce(F.size("topics"), F.lit(0)) / F.lit(5.0), F.lit(1.0)), 0.15),
                      ("homepage", flag(F.coalesce(c("homepage") != "", F.lit(False))), 0.05),
                      ("contributors", pct("contributors", c("contributors")), 0.20)],
    }


def trust(w: Weights = Weights()) -> Column:
    """Product of the penalties that a repository's flags and proportions earn."""
    c = F.col
    stars = F.coalesce(c("stars"), F.lit(0))
    when = lambda cond, f: F.when(F.coalesce(cond, F.lit(False)), F.lit(f)).otherwise(F.lit(1.0))
    ratio = F.when(stars >= 10, F.coalesce(c("forks"), F.lit(0)) / stars)
    odd = (stars >= w.anomaly_min_stars) & (
        F.coalesce(ratio < w.anomaly_fork_ratio, F.lit(False)) | F.coalesce((c("contributors") <= 1) & (stars >= 2000), F.lit(False)))
    return (when(c("archived"), w.archived_factor) * when(c("is_fork"), w.fork_factor) * when(c("disabled"), w.disabled_factor)
            * when(c("is_template"), w.template_factor) * F.when(F.coalesce(c("license") != "", F.lit(False)), F.lit(1.0)).otherwise(F.lit(w.unlicensed_factor))
            * when(c("skill_count") > w.dump_threshold, w.dump_factor) * when(odd, w.anomaly_factor))


def repo_base(parts: dict[str, list[Part]], w: Weights = Weights()) -> Column:
    """The families' blend, 0..1."""
    return blend([(name, blend(parts[name]), getattr(w, name)) for name in ("popularity", "momentum", "maintenance", "authority")])


def craft_parts(q) -> list[Part]:
    """Components of how well a document is made."""
    c = F.col
    n = F.length(F.coalesce(c("description"), F.lit("")))
    fit = F.when(n == 0, 0.0).when(n < 40, 0.35).when(n <= 700, 1.0).when(n <= 1024, 0.8).otherwise(0.55)
    listed = lambda col: F.coalesce(F.size(F.from_json(col, "array<string>")), F.lit(0))
    listed_n = lambda col: F.greatest(listed(col), F.lit(0))
    noted = F.size(F.filter(F.split(F.coalesce(c("warnings"), F.lit("")), "; "), lambda x: x != ""))
    return [
        ("valid", F.when(c("valid") == 1, 1.0).otherwise(0.0), 0.28), ("description_fit", fit, 0.22),
        ("body_depth", mid_rank(q("body_len"), c("body_len")), 0.20),
        ("bundled_resources", mid_rank(q("resource_count"), listed_n(c("resources"))), 0.15),
        ("declares_tools", F.when(listed_n(c("allowed_tools")) > 0, 1.0).otherwise(0.0), 0.07),
        ("spec_clean", F.greatest(F.lit(0.0), 1.0 - F.lit(0.34) * noted), 0.08),
    ]


def distinct_parts(copies: Column, owners: Column, same_name: Column, in_repo: Column) -> list[Part]:
    """Components of how much a document is one of its kind."""
    o = F.greatest(F.coalesce(owners, F.lit(1)), F.lit(1))
    per_owner = F.greatest(F.greatest(F.coalesce(copies, F.lit(1)), F.lit(1)) / o, F.lit(1.0))
    names = F.greatest(F.coalesce(same_name, F.lit(1)), F.lit(1))
    size = F.when(F.coalesce(in_repo, F.lit(0)) == 0, F.lit(1)).otherwise(in_repo)
    return [
        ("adoption", 0.5 + 0.5 * F.least(F.lit(1.0), F.log2(1 + o) / 11.0), 0.40),
        ("not_sprawl", 1.0 / (1.0 + F.log2(per_owner)), 0.20),
        ("name_uniqueness", 1.0 / (1.0 + 0.5 * F.log2(names.cast("double"))), 0.20),
        ("repo_focus", F.when(size <= 60, F.lit(1.0)).otherwise(F.greatest(F.lit(0.25), F.lit(60.0) / size)), 0.20),
    ]


def safety_factor(level: Column) -> Column:
    """What a safety level leaves of a score; unknown levels leave all of it."""
    out = None
    for name, factor in SAFETY_FACTORS.items():
        out = F.when(level == name, factor) if out is None else out.when(level == name, factor)
    return out.otherwise(1.0)


def author_parts(now: Column, q) -> list[Part]:
    """Components of an author's score, from a profile row."""
    c = F.col
    n = F.coalesce(c("skills"), F.lit(0))
    work = F.when(n > 0, F.least(F.lit(1.0), F.log10(n + 1) / 2.0)).otherwise(0.0)
    steady = blend([("licensed", c("licensed_rate"), 0.45), ("described", c("described_rate"), 0.35),
                    ("multi_repo", F.least(F.lit(1.0), F.coalesce(c("skill_repos"), F.lit(0)) / 3.0), 0.20)])
    return [
        ("craft", c("median_craft"), 0.30), ("originality", F.when(n > 0, c("original_skills") / n), 0.22),
        ("reach", mid_rank(q("author_stars"), c("total_stars")), 0.16), ("followers", mid_rank(q("author_followers"), c("followers")), 0.08),
        ("body_of_work", work, 0.10), ("consistency", steady, 0.08),
        ("longevity", at_most(days_since(c("first_repo_at"), now) / 540.0, 1.0), 0.03),
        ("still_active", recency(days_since(c("last_push_at"), now), 180.0), 0.03),
    ]


def prior_score(stars: Column, description: Column, body_len: Column, n_resources: Column, n_tools: Column, licensed: Column,
                days_since_push: Column, n_warnings: Column, is_fork: Column, archived: Column, copies: Column) -> Column:
    """Additive quality prior of 0..100 that needs no corpus."""
    n = F.length(F.coalesce(description, F.lit("")))
    s = (F.least(F.lit(35.0), 9.0 * F.log10(F.greatest(F.coalesce(stars, F.lit(0)), F.lit(0)) + 1.0))
         + F.when(n.between(40, 600), 12.0).when(n > 0, 5.0).otherwise(0.0)
         + F.when(body_len >= 400, 10.0).when(body_len >= 150, 5.0).otherwise(0.0)
         + F.least(F.lit(8.0), 2.0 * n_resources) + F.when(n_tools > 0, 3.0).otherwise(0.0) + F.when(licensed, 6.0).otherwise(0.0)
         + 14.0 * F.exp(-F.coalesce(days_since_push, F.lit(9999.0)) / 240.0) - 4.0 * n_warnings
         - F.when(is_fork, 12.0).otherwise(0.0) - F.when(archived, 10.0).otherwise(0.0)
         - F.when(copies > 1, F.least(F.lit(15.0), 3.0 * F.log2(copies + 1.0))).otherwise(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)), 2)
