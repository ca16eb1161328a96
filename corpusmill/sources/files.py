"""File-backed sources: NDJSON events, seed lists, API rows, archives.

Network access is not part of the engine: what a crawler downloads lies in files
or is handed over as rows, and is normalised here.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import next_link, repo_links
from corpusmill.operators.latest import latest
from corpusmill.schema import EVENTS

# Event types that tell of changed repositories.
EVENT_TYPES = ("PushEvent", "CreateEvent", "ReleaseEvent")
WIDE_EVENT_TYPES = (*EVENT_TYPES, "PublicEvent", "ForkEvent", "PullRequestEvent")
NOT_OWNERS = ("topics", "features", "sponsors", "about", "apps", "orgs", "marketplace", "settings", "search", "login", "explore", "site", "collections", "pricing")
API_ROW = ("full_name string, name string, owner struct<login:string,type:string>, default_branch string, description string, homepage string, "
           "language string, stargazers_count bigint, forks_count bigint, subscribers_count bigint, open_issues_count bigint, size bigint, "
           "license struct<spdx_id:string>, topics array<string>, created_at timestamp, updated_at timestamp, pushed_at timestamp, fork boolean, "
           "archived boolean, disabled boolean, is_template boolean, has_issues boolean, has_wiki boolean, has_pages boolean, has_discussions boolean")
GRAPHQL_ROW = ("nameWithOwner string, name string, owner struct<login:string,__typename:string>, defaultBranchRef struct<name:string>, "
               "description string, homepageUrl string, primaryLanguage struct<name:string>, stargazerCount bigint, forkCount bigint, "
               "watchers struct<totalCount:bigint>, issues struct<totalCount:bigint>, diskUsage bigint, licenseInfo struct<spdxId:string>, "
               "createdAt timestamp, updatedAt timestamp, pushedAt timestamp, isFork boolean, isArchived boolean, isDisabled boolean, "
               "isTemplate boolean, hasIssuesEnabled boolean, hasWikiEnabled boolean, releases struct<totalCount:bigint>")


def event_files(spark: SparkSession, paths: str | list[str], types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Events of gzipped NDJSON files, of the wanted types only; broken lines are skipped."""
    rows = spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(paths)
    return rows.filter(F.col("type").isin(*types)).select("type", F.col("repo.name").alias("repo"), "created_at", F.col("actor.login").alias("actor"))


def split_events(events: DataFrame, known: DataFrame, hints: list[str]) -> tuple[DataFrame, DataFrame]:
    """(known repositories to refresh, unknown ones whose name has a hint), each repository once.

    Hints are literal substrings, matched ignoring case by one expression.
    """
    repos = events.select(F.col("repo").alias("full_name")).filter("full_name IS NOT NULL").distinct()
    names = known.select("full_name")
    import re

    pattern = "(?i)" + "|".join(re.escape(h) for h in hints) if hints else "(?!)"
    return repos.join(names, "full_name", "left_semi"), repos.join(names, "full_name", "left_anti").filter(F.col("full_name").rlike(pattern))


def requests(repos: DataFrame, priority: int, reason: str, at: Column) -> DataFrame:
    """Rows of the queue for repositories."""
    return repos.select("full_name", F.lit(priority).alias("priority"), F.lit(reason).alias("reason"), at.alias("enqueued_at"), F.lit(0).alias("attempts"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Repository names of a text file: one a line, ``#`` starts a comment, a name needs a slash."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("full_name")).filter(F.col("full_name").contains("/")).distinct()


def mined_links(pages: DataFrame, text: str, own: str | None = None, host: str = "github.com") -> DataFrame:
    """(full_name): repositories that Markdown or HTML pages link to, without a page's own and without site pages."""
    links = pages.select(*([F.col(own).alias("_own")] if own else []), F.explode(repo_links(F.col(text), host)).alias("full_name"))
    good = ~F.lower(F.substring_index("full_name", "/", 1)).isin(*NOT_OWNERS)
    if own:
        good = good & ~F.lower("full_name").eqNullSafe(F.lower(F.col("_own")))
    return links.filter(good).select("full_name").distinct()


def from_api(raw: Column, now: Column) -> list[Column]:
    """Columns of a repository row from the JSON text of a REST answer; unusable licences are null."""
    r = F.from_json(raw, API_ROW)
    licence = F.when(~r["license"]["spdx_id"].isin("NOASSERTION", ""), r["license"]["spdx_id"])
    plain = ["default_branch", "description", "homepage", "language", "topics", "created_at", "updated_at", "pushed_at", "archived", "disabled",
             "is_template", "has_issues", "has_wiki", "has_pages", "has_discussions"]
    return [r["full_name"].alias("full_name"), r["owner"]["login"].alias("owner"), r["name"].alias("name"), r["owner"]["type"].alias("owner_type"),
            r["stargazers_count"].alias("stars"), r["forks_count"].alias("forks"), r["subscribers_count"].alias("subscribers"),
            r["open_issues_count"].alias("open_issues"), r["size"].alias("size_kb"), licence.alias("license"), r["fork"].alias("is_fork"),
            *[r[c].alias(c) for c in plain], now.alias("last_meta_at")]


def from_graphql(raw: Column, now: Column) -> list[Column]:
    """Columns of a repository row from the JSON text of a GraphQL node."""
    r = F.from_json(raw, GRAPHQL_ROW)
    licence = F.when(~r["licenseInfo"]["spdxId"].isin("NOASSERTION", ""), r["licenseInfo"]["spdxId"])
    return [r["nameWithOwner"].alias("full_name"), r["owner"]["login"].alias("owner"), r["name"].alias("name"),
            F.when(r["owner"]["__typename"] == "Organization", "Organization").otherwise("User").alias("owner_type"),
            r["defaultBranchRef"]["name"].alias("default_branch"), r["description"].alias("description"), r["homepageUrl"].alias("homepage"),
            r["primaryLanguage"]["name"].alias("language"), r["stargazerCount"].alias("stars"), r["forkCount"].alias("forks"),
            r["watchers"]["totalCount"].alias("subscribers"), r["issues"]["totalCount"].alias("open_issues"), r["diskUsage"].alias("size_kb"),
            licence.alias("license"), r["createdAt"].alias("created_at"), r["updatedAt"].alias("updated_at"), r["pushedAt"].alias("pushed_at"),
            r["isFork"].alias("is_fork"), r["isArchived"].alias("archived"), r["isDisabled"].alias("disabled"), r["isTemplate"].alias("is_template"),
            r["hasIssuesEnabled"].alias("has_issues"), r["hasWikiEnabled"].alias("has_wiki"), r["releases"]["totalCount"].alias("releases"),
            now.alias("last_meta_at")]


GITLAB_ROW = ("path_with_namespace string, path string, namespace struct<path:string,kind:string>, default_branch string, description string, star_count bigint, "
              "forks_count bigint, open_issues_count bigint, topics array<string>, created_at timestamp, last_activity_at timestamp, archived boolean")
HUB_ROW = "id string, author string, likes bigint, tags array<string>, createdAt timestamp, lastModified timestamp, disabled boolean, siblings array<struct<rfilename:string>>"


def from_gitlab(raw: Column, now: Column, host: str = "gitlab.com") -> list[Column]:
    """Columns of a repository row from a project's JSON; names carry the host, as forges share none."""
    r = F.from_json(raw, GITLAB_ROW)
    return [F.concat(F.lit(host + "/"), r["path_with_namespace"]).alias("full_name"), r["namespace"]["path"].alias("owner"), r["path"].alias("name"),
            F.when(r["namespace"]["kind"] == "group", "Organization").otherwise("User").alias("owner_type"), r["default_branch"].alias("default_branch"),
            r["description"].alias("description"), r["star_count"].alias("stars"), r["forks_count"].alias("forks"), r["open_issues_count"].alias("open_issues"),
            r["topics"].alias("topics"), r["created_at"].alias("created_at"), r["last_activity_at"].alias("pushed_at"), r["archived"].alias("archived"),
            F.lit(host).alias("host"), now.alias("last_meta_at")]


def from_hub(raw: Column, now: Column, host: str = "huggingface.co") -> list[Column]:
    """Columns of a repository row, and the paths of its documents, from a model hub's JSON."""
    r = F.from_json(raw, HUB_ROW)
    licence = F.try_element_at(F.filter(r["tags"], lambda t: t.startswith("license:")), F.lit(1))
    paths = F.filter(F.transform(r["siblings"], lambda x: x["rfilename"]), lambda p: F.lower(F.substring_index(p, "/", -1)) == "skill.md")
    return [F.concat(F.lit(host + "/"), r["id"]).alias("full_name"), r["author"].alias("owner"), F.substring_index(r["id"], "/", -1).alias("name"),
            r["likes"].alias("stars"), F.regexp_replace(licence, "^license:", "").alias("license"), r["tags"].alias("topics"), r["createdAt"].alias("created_at"),
            r["lastModified"].alias("pushed_at"), r["disabled"].alias("disabled"), F.lit(host).alias("host"), paths.alias("paths"), now.alias("last_meta_at")]


def compact(spark: SparkSession, source: str, target: str, rows_per_file: int = 5_000_000, sort: str | None = None) -> None:
    """Rewrite a Parquet dataset in fewer, larger files; with ``sort`` range-partitioned by it, so that filters on it skip files."""
    df = spark.read.parquet(source)
    files = max(1, -(-df.count() // rows_per_file))
    shaped = df.repartitionByRange(files, sort).sortWithinPartitions(sort) if sort else df.repartition(files)
    shaped.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(target)


def archive_members(blob: bytes, wanted=lambda p: p.rsplit("/", 1)[-1].lower() == "skill.md", most: int | None = None, largest: int | None = None) -> Iterator[tuple[str, str]]:
    """(path without the top folder, text) of the wanted members of a tar.gz; a broken archive ends early.

    ``most`` members and ``largest`` bytes of one are limits for archives not to be trusted (the reference's: 5,000 and 512 KiB).
    """
    n = 0
    try:
        with tarfile.open(fileobj=io.BytesIO(blob), mode="r|gz") as tar:
            for member in tar:
                path = member.name.split("/", 1)[-1]
                if not member.isfile() or not wanted(path) or largest is not None and member.size > largest:
                    continue
                yield path, tar.extractfile(member).read().decode("utf-8", "replace")
                n += 1
                if n == most:
                    return
    except (tarfile.TarError, EOFError, OSError):
        return


def archives(spark: SparkSession, path: str, pattern: str = "*.tar.gz", bundled: bool = False) -> DataFrame:
    """(archive, path, text) of the documents in all archives below a folder; members stream, archives are never unpacked to disk.

    bundled: with it the runnable files come as well.
    """
    document = lambda p: p.rsplit("/", 1)[-1].lower() == "skill.md"
    wanted = (lambda p: document(p) or runnable(p)) if bundled else document
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blob in zip(frame["path"], frame["content"]):
                rows = [(name, p, t) for p, t in archive_members(bytes(blob), wanted)]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "path", "text"])

    return blobs.mapInPandas(run, "archive string, path string, text string")


def owned_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, file): each bundled file with the document whose folder is its longest prefix, inside one repository.

    A file asks each of its own folders, of which a path has few, for a document; folders and
    documents meet by equality. Of the documents of a folder the first by path is meant, or the
    second for the first itself, so a folder is one row however many documents lie in it.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    placed = documents.filter("repo IS NOT NULL AND path IS NOT NULL").select("repo", "path", folder.alias("_dir"))
    place = F.dense_rank().over(Window.partitionBy("repo", "_dir").orderBy("path"))
    two = placed.withColumn("_r", place).filter("_r <= 2")
    homes = two.groupBy("repo", "_dir").agg(F.min("path").alias("_one"), F.min(F.when(F.col("_r") == 2, F.col("path"))).alias("_two"))
    parts = F.split(folder, "/")  # ends with an empty one
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = files.select("repo", F.col("path").alias("file"), F.explode(ups).alias("_up")).withColumn("_dir", F.when(F.col("_up") == "", "").otherwise(F.concat("_up", F.lit("/"))))
    joined = asked.drop("_up").join(homes, ["repo", "_dir"]).withColumn("path", F.when(F.col("file") == F.col("_one"), F.col("_two")).otherwise(F.col("_one")))
    return joined.filter("path IS NOT NULL").groupBy("repo", "file").agg(F.max_by("path", F.length("_dir")).alias("path")).select("repo", "path", "file")


def hour_names(now: datetime, hours: int, lag: int = 1) -> list[str]:
    """Names of the last hourly event files, newest first: YYYY-MM-DD-H."""
    return [f"{t:%Y-%m-%d}-{t.hour}" for t in (now - timedelta(hours=lag + i) for i in range(hours))]


def next_page(header: Column) -> Column:
    """Number of the next page that a Link header names, null if there is none."""
    return F.regexp_extract(next_link(header), r"[?&]page=([0-9]+)", 1).try_cast("int")


def last_page(header: Column) -> Column:
    """Number of the last page that a Link header names, null if there is none."""
    return F.regexp_extract(next_link(header, "last"), r"[?&]page=([0-9]+)", 1).try_cast("int")


def unless_changed(answers: DataFrame, known: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """(answers with news, known entity tags afterwards) of conditional requests.

    answers: (key, status, etag, body, at). A 304 repeats what is known; of several
    answers for a key the latest counts.
    """
    latest_ = latest(answers, key, "at", [c for c in answers.columns if c not in (key, "at")] + ["at"])
    fresh = latest_.filter((F.col("status") == 200) & F.col("body").isNotNull())
    joined = fresh.join(known.select(key, F.col("etag").alias("_etag")), key, "left")
    news = joined.filter(F.col("etag").isNull() | ~F.col("etag").eqNullSafe(F.col("_etag"))).drop("_etag")
    tags = known.join(fresh.select(key), key, "left_anti").select(key, "etag").unionByName(fresh.filter("etag IS NOT NULL").select(key, "etag"))
    return news, tags


# How files that run end.
RUNNABLE = (".py", ".sh", ".bash", ".zsh", ".js", ".mjs", ".ts", ".rb", ".pl", ".ps1", ".bat", ".cmd", ".php", ".lua")


def runnable(path: str) -> bool:
    """Whether a bundled file is one that runs."""
    return path.lower().endswith(RUNNABLE)


def date_shards(first: date, last: date, count, most: int = 1000) -> list[tuple[date, date]]:
    """Date ranges whose count is at most ``most`` (or that are one day), by halving: partitions of a limited search."""
    out, stack = [], [(first, last)]
    while stack:
        a, b = stack.pop()
        if a < b and count(a, b) > most:
            mid = a + (b - a) // 2
            stack += [(mid + timedelta(days=1), b), (a, mid)]
        else:
            out.append((a, b))
    return out
