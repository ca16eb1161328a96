"""Predicates built from request parameters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def servable(columns: list[str]) -> Column:
    """Whether a row may be shown, with whatever safety columns there are.

    A decision on the row is authoritative; without one the rule level stands in;
    without any safety column nothing is withheld.
    """
    by_level = F.coalesce(F.col("risk_level"), F.lit("none")) != "critical" if "risk_level" in columns else F.lit(True)
    if "risk_action" in columns:
        return F.when(F.col("risk_action").isNotNull(), F.col("risk_action") != "block").otherwise(by_level)
    return by_level


def request_filter(filters: Mapping[str, Any], columns: list[str], now: Column | None = None) -> Column:
    """Conjunction of the filters of a search request.

    Names are those of a join of documents with their repositories, whose licence
    is ``repo_license``. Empty values mean no filter; invalid rows, forks and
    archived repositories are left out unless asked for. ``max_age_days`` needs
    ``now``. A row whose column is null fails a filter on it.
    """
    f = dict(filters or {})
    c = F.col
    out = F.lit(True)
    if f.get("valid_only", True):
        out = out & (c("valid") == 1)
    if not f.get("include_unsafe"):
        out = out & servable(columns)
    if f.get("min_stars"):
        out = out & (c("stars") >= int(f["min_stars"]))
    if f.get("license"):
        out = out & ((c("license") == f["license"]) | (c("repo_license") == f["license"]))
    for name, column in (("kind", "source_kind"), ("language", "language"), ("owner_type", "owner_type"), ("category", "category")):
        if f.get(name):
            out = out & (c(column) == f[name])
    if f.get("min_score"):
        out = out & (c("score") >= float(f["min_score"]))
    if f.get("max_age_days"):
        limit = (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(int(f["max_age_days"])))
        out = out & (c("pushed_at") >= limit)
    if f.get("repo"):
        out = out & c("repo").ilike(f"%{f['repo']}%")
    if not f.get("include_forks"):
        out = out & ~c("is_fork")
    if not f.get("include_archived"):
        out = out & ~c("archived")
    return out


def from_params(params: Mapping[str, str]) -> dict[str, Any]:
    """Filters from text parameters; empty ones and unknown names are ignored, bad numbers too."""
    out: dict[str, Any] = {}
    for name in ("license", "kind", "language", "owner_type", "repo", "category"):
        if params.get(name):
            out[name] = params[name]
    for name, kind in (("min_stars", int), ("min_score", float), ("max_age_days", int)):
        try:
            out[name] = kind(params[name])
        except (KeyError, ValueError, TypeError):
            continue
    for name in ("include_forks", "include_archived", "include_unsafe"):
        if str(params.get(name, "")).lower() in ("1", "true", "yes"):
            out[name] = True
    return out


def shard(key: Column, shards: int, number: int) -> Column:
    """Whether a key belongs to one of ``shards`` even parts."""
    return F.pmod(F.xxhash64(key), F.lit(shards)) == number
