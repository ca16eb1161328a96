"""Problem 8: filling fixed-capacity containers with items of varying length.

Sizes are counted where the texts lie; only (id, size) goes on. A global histogram
of sizes, which has at most `capacity` entries whatever the number of items, is
all the planner sees: dynamic programming chooses the length buckets that lose
least by rounding sizes up, and containers are then planned over the buckets as
patterns with a multiplicity. Items take the planned places by their rank inside
the bucket, so no task and no driver ever holds the items of a bucket.

Batches of one bucket alone would leave up to half of a container unused for items
above half its capacity, so a pattern may combine several buckets; most containers
of small items still come from one bucket.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranks import global_rank
from corpusmill.runtime import materialise, small_rows

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Function that counts the tokens of texts with the vocabulary file at ``path``.

    ``.tiktoken`` files are byte-level BPE ranks, ``.json`` and ``.model`` files are
    read by their own libraries. Strings of special tokens are ordinary text.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def token_sizes(df: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every row with a non-null key; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            sizes = count([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    rows = df.select(key, text).filter(F.col(key).isNotNull())
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")


def length_buckets(sizes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of at most ``k`` buckets over a histogram that waste least padding.

    sizes: rising distinct sizes. Minimises sum(count * (bound - size)) exactly;
    the last bound is the largest size. O(k n log n) by divide and conquer, as
    the best split moves monotonically.
    """
    n = len(sizes)
    if n <= k:
        return sizes.copy()
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    w = np.concatenate(([0], np.cumsum(counts * sizes, dtype=np.float64)))
    best = sizes * c[1:] - w[1:]  # one bucket for the first j + 1 sizes
    splits = np.zeros((k, n), np.int64)
    for level in range(1, k):
        before = np.concatenate(([0.0], best[:-1]))  # cost of all sizes below i
        new = np.empty(n)
        # All halves of one depth together: ends lo..hi, splits a..b.
        lo, hi, a, b = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(j, b) - a + 1
            start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(j)), size)
            i = np.arange(len(owner)) - start[owner] + a[owner]
            end = j[owner]
            cost = before[i] + sizes[end] * (c[end + 1] - c[i]) - (w[end + 1] - w[i])
            least = np.minimum.reduceat(cost, start)
            at = np.flatnonzero(cost == least[owner])
            m = i[at[np.unique(owner[at], return_index=True)[1]]]
            new[j], splits[level, j] = least, m
            lo, hi, a, b = np.concatenate((lo, j + 1)), np.concatenate((j - 1, hi)), np.concatenate((a, m)), np.concatenate((m, b))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        best = new
    bounds, j, level = [], n - 1, k - 1
    while j >= 0:
        bounds.append(sizes[j])
        if level == 0:
            break
        j, level = int(splits[level, j]) - 1, level - 1
    return np.array(bounds[::-1])


def plan(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Containers as patterns over buckets: (bucket, first rank, end rank, first container, places each).

    Greedy by size: a pattern starts with the largest bucket left and goes on
    with the largest that still fits, as often as it fits; it is repeated until
    one of its buckets runs short. Each round empties a bucket or shortens it
    below one pattern's worth, so there are few rounds per bucket.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(len(left), np.int64)
    out, container = [], 0
    while left.any():
        room, pattern = capacity, []
        for b in range(len(bounds) - 1, -1, -1):
            take = min(room // int(bounds[b]), int(left[b])) if bounds[b] <= room else 0
            if take:
                pattern.append((b, take))
                room -= take * int(bounds[b])
        times = min(int(left[b]) // take for b, take in pattern)
        for b, take in pattern:
            out.append((b, int(used[b]), int(used[b] + take * times), container, take))
            used[b] += take * times
            left[b] -= take * times
        container += times
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, k: int = 128) -> DataFrame:
    """(key, piece, n, container): every item in a container of ``capacity``.

    items: one row per key with its size. An item larger than the capacity is the
    only kind that is split: into pieces of exactly ``capacity`` (a container
    each) and a remainder, which is packed like an item; pieces count from 0.
    Sizes that are null or below 1 take no room and no container: they do not
    appear. Equal sizes are ordered by key, so the result is deterministic.

    k: number of length buckets. The sizes lose at most what the buckets pad;
    more buckets waste less and make a longer plan.
    """
    spark = items.sparkSession
    pos = items.filter(F.col(key).isNotNull() & (F.col(size) >= 1)).select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_n"))
    whole = F.floor(F.col("_n") / capacity).cast("bigint")
    rest = F.col("_n") % capacity
    pieces = pos.select(
        "_key",
        F.explode(F.concat(
            F.transform(F.when(whole > 0, F.sequence(F.lit(0).cast("bigint"), whole - 1)).otherwise(F.array().cast("array<bigint>")),
                        lambda i: F.struct(i.alias("piece"), F.lit(capacity).cast("bigint").alias("n"))),
            F.when(rest > 0, F.array(F.struct(whole.alias("piece"), rest.alias("n")))).otherwise(
                F.array().cast("array<struct<piece:bigint,n:bigint>>")),
        )).alias("_p"),
    ).select("_key", F.col("_p.piece").alias("piece"), F.col("_p.n").alias("n"))
    pieces = materialise(pieces, "pieces")
    histogram = small_rows(pieces.groupBy("n").agg(F.count("*").alias("c")).orderBy("n"), capacity, "sizes")
    sizes = np.array([r["n"] for r in histogram], np.int64)
    counts = np.array([r["c"] for r in histogram], np.int64)
    if not len(sizes):
        return pieces.select(F.col("_key").alias(key), "piece", "n", F.lit(None).cast("bigint").alias("container"))
    bounds = length_buckets(sizes, counts, k)
    bucket_of = np.searchsorted(bounds, sizes)
    per_bucket = np.bincount(bucket_of, weights=counts, minlength=len(bounds)).astype(np.int64)
    places = plan(bounds, per_bucket, capacity)

    edges = F.array(*[F.lit(int(b)) for b in bounds[:-1]]) if len(bounds) > 1 else F.array().cast("array<int>")
    bucketed = pieces.withColumn("_b", F.size(F.filter(edges, lambda e: e < F.col("n"))))
    # Within a bucket larger sizes first: containers of one pattern then get items of like size.
    ranked = global_rank(bucketed, ["_b"], [F.col("n").desc(), F.col("_key").asc(), F.col("piece").asc()], "_r")
    shared = spark.sparkContext.broadcast(_lookup(places, len(bounds)))  # rows: a few per bucket

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, rows, offsets = shared.value
        for batch in batches:
            b = batch.column(3).to_numpy()
            r = batch.column(4).to_numpy()
            out = np.empty(len(b), np.int64)
            for bucket in np.unique(b).tolist():
                m = b == bucket
                at = slice(offsets[bucket], offsets[bucket + 1])
                i = np.searchsorted(start[at], r[m], "right") - 1
                chosen = rows[at][i]
                out[m] = chosen[:, 1] + (r[m] - chosen[:, 0]) // chosen[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=[key, "piece", "n", "container"])

    key_type = items.schema[key].dataType.simpleString()
    return ranked.select("_key", "piece", "n", F.col("_b").cast("bigint"), "_r").mapInArrow(
        seat, f"`{key}` {key_type}, piece bigint, n bigint, container bigint")


def _lookup(places: Sequence[tuple[int, int, int, int, int]], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The plan by bucket and first rank: (first ranks, (first rank, container, places each), bucket offsets)."""
    rows = np.array(sorted((b, first, container, each) for b, first, _, container, each in places), np.int64).reshape(-1, 4)
    return rows[:, 1], rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(n_buckets + 1))


def pack_targets(items: DataFrame, key: str, size: str, targets: Sequence[tuple[int, int]], k: int = 128) -> DataFrame:
    """(target_id, container, key, piece, n) for each of a few (target_id, capacity)."""
    out = None
    for target_id, capacity in targets:
        packed = pack(items, key, size, capacity, k).select(F.lit(target_id).cast("bigint").alias("target_id"), "container", key, "piece", "n")
        out = packed if out is None else out.unionByName(packed)
    return out
