"""Web sources: paged answers, conditional requests, raw files, sharded searches.

Requests are rows: a DataFrame of addresses is fetched inside the tasks, every page
of an address in turn, and answers come back as rows that ``files`` normalises. A
``fetch`` function does the transport, so that pacing, tokens and tests are the
caller's; the default uses the standard library. ``paged`` is the same as a data
source for ``spark.read``.
"""

from __future__ import annotations

import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ANSWER = "url string, page int, address string, status int, etag string, body string"
Answer = tuple[int, Mapping[str, str], str | None]
NEXT = re.compile(r"<([^>]+)>\s*;\s*rel=\"?next\"?")


def open_url(address: str, headers: Mapping[str, str]) -> Answer:
    """(status, headers, body) of a GET; an error status is an answer, a broken connection is status 0."""
    try:
        with urllib.request.urlopen(urllib.request.Request(address, headers=dict(headers)), timeout=60) as r:
            return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), None
    except (urllib.error.URLError, OSError, ValueError):
        return 0, {}, None


def pages(url: str, etag: str | None = None, headers: Mapping[str, str] | None = None, fetch: Callable[[str, Mapping[str, str]], Answer] = open_url,
          most: int | None = None) -> Iterator[tuple]:
    """Rows of ``ANSWER``: the pages of an address, following the Link header until there is no next one.

    etag: what is known of the first page; if it still holds, a 304 is the only row.
    An answer that isn't 200 ends the walk. most: a limit on pages, none by default;
    an address that comes again ends the walk too.
    """
    address, n, seen = url, 0, set()
    while address and address not in seen and (most is None or n < most):
        seen.add(address)
        n += 1
        asked = {**(headers or {}), **({"If-None-Match": etag} if etag and n == 1 else {})}
        status, said, body = fetch(address, asked)
        low = {k.lower(): v for k, v in said.items()}
        yield url, n, address, status, low.get("etag"), body if status == 200 else None
        following = NEXT.search(low.get("link") or "") if status == 200 else None
        address = following.group(1) if following else ""


def fetched(requests: DataFrame, url: str, etag: str | None = None, headers: Mapping[str, str] | None = None,
            fetch: Callable[[str, Mapping[str, str]], Answer] = open_url, most: int | None = None, at_once: int | None = None) -> DataFrame:
    """Rows of ``ANSWER`` for the addresses in ``requests``, each walked page by page inside a task.

    etag: column of known entity tags. at_once: tasks that ask at the same time, by
    default as many as the requests have partitions. Null addresses are left out.
    """
    rows = requests.filter(F.col(url).isNotNull()).select(F.col(url).alias("url"), (F.col(etag) if etag else F.lit(None)).cast("string").alias("etag"))
    rows = rows.repartition(at_once) if at_once else rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ANSWER.split(", ")]
        for frame in frames:
            for address, tag in zip(frame["url"], frame["etag"]):
                for row in pages(address, tag if isinstance(tag, str) else None, headers, fetch, most):
                    yield pd.DataFrame([row], columns=names)

    return rows.mapInPandas(run, ANSWER)


class PagedSource(DataSource):
    """``spark.read.format("paged").option("urls", "...")``: one partition an address, its pages as rows.

    Options: urls (separated by white space), most (pages of an address), and
    header.NAME for request headers.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.urls = options.get("urls", "").split()
        self.most = int(options["most"]) if options.get("most") else None
        self.headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None and partition.value:
            yield from pages(partition.value, headers=self.headers, most=self.most)


def register(spark: SparkSession) -> None:
    """Make the data source ``paged`` known to a session."""
    spark.dataSource.register(PagedSource)


def raw_url(repo: Column, branch: Column, path: Column, host: str = "https://raw.githubusercontent.com") -> Column:
    """Address of a file's text."""
    return F.concat_ws("/", F.lit(host), repo, F.coalesce(branch, F.lit("HEAD")), path)


def graphql_batches(repos: DataFrame, fields: str, size: int = 50) -> DataFrame:
    """(batch, n, query): one query for every ``size`` repositories, each under an alias r0, r1, ...

    repos: (full_name). Names without a slash or with a quotation mark are left out.
    """
    from corpusmill.operators.ranks import global_rank

    good = repos.select("full_name").distinct().filter(F.col("full_name").rlike(r'^[^/"\\\s]+/[^/"\\\s]+$'))
    placed = global_rank(good, [], [F.col("full_name")], "_i").withColumn("batch", F.floor(F.col("_i") / size)).withColumn("_i", F.col("_i") % size)
    each = F.concat(F.lit("r"), F.col("_i"), F.lit(': repository(owner: "'), F.split_part("full_name", F.lit("/"), F.lit(1)), F.lit('", name: "'),
                    F.split_part("full_name", F.lit("/"), F.lit(2)), F.lit(f'") {{ {fields} }}'))
    lists = placed.select("batch", "_i", each.alias("q")).groupBy("batch").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "q"))).alias("_q"))
    return lists.select("batch", "n", F.concat(F.lit("query { "), F.array_join("_q.q", " "), F.lit(" }")).alias("query"))


def size_shards(low: int, high: int, count: Callable[[int, int], int], most: int = 1000) -> list[tuple[int, int]]:
    """Ranges low..high of file sizes whose count is at most ``most`` (or that are one size), by halving; empty ones are left out."""
    out, stack = [], [(low, high)]
    while stack:
        a, b = stack.pop()
        n = count(a, b)
        if n > most and a < b:
            mid = (a + b) // 2
            stack += [(mid + 1, b), (a, mid)]
        elif n:
            out.append((a, b))
    return out


def sweep_queries(topics: Sequence[str] = (), keywords: Sequence[str] = (), stars: Sequence[tuple[int, int | None]] = ((0, None),)) -> list[str]:
    """Search texts of a sweep: every topic and keyword in every band of stars."""
    bands = [f"stars:{a}..{b}" if b is not None else f"stars:>={a}" for a, b in stars]
    terms = [f"topic:{t}" for t in topics] + [f'"{w}" in:name,description,readme' for w in keywords]
    return [f"{t} {b}" for t in terms for b in bands]
