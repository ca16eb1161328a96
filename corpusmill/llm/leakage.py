"""Problem 9: evaluation texts leaking into training text.

The test items are a stated query set: they are taken in blocks of bounded size,
each block becomes a small index that is broadcast, and all documents stream past
it once. Windows of words are embedded by the CGK random walk, which turns edit
distance into Hamming distance; repeated samples of its bits are the buckets in
which document windows meet item windows, and an exact check of the edit distance
decides. Equal windows take equal walks, so at distance 0 none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernel as k
from corpusmill.operators.ranks import prefix_sums
from corpusmill.runtime import materialise


def walk_bits(windows: np.ndarray, seed: int, length: int) -> np.ndarray:
    """CGK embedding of rows of symbols: ``length`` output symbols a row.

    At step t the walk emits the symbol it stands on and moves on by a random bit
    that depends on t and on that symbol only. Beyond the end it emits a pad.
    """
    n, w = windows.shape
    at = np.zeros(n, np.int64)
    out = np.zeros((n, length), k.U)
    rows = np.arange(n)
    padded = np.concatenate((windows, np.full((n, 1), k.U(0x5BD1E995))), axis=1)
    for t in range(length):
        symbol = padded[rows, at]
        out[:, t] = symbol
        coin = k.mix(symbol ^ k.U((seed * 1_000_003 + t * 7919 + 1) & 0xFFFFFFFFFFFFFFFF)) >> k.U(63)
        at = np.minimum(at + coin.astype(np.int64), w)
    return out


def buckets(windows: np.ndarray, seed: int, length: int, bits: int) -> np.ndarray:
    """Bucket of each window in one repetition: a hash of ``bits`` sampled places of its walk."""
    places = np.sort(np.random.default_rng(seed).choice(length, size=min(bits, length), replace=False))
    walk = walk_bits(windows, seed, int(places[-1]) + 1)[:, places]
    out = np.full(len(windows), k.U(seed + 1))
    for j in range(walk.shape[1]):
        out = k.mix(out * k.BASE_WINDOW + walk[:, j])
    return out


def within_edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the rows of ``a`` and ``b``, word sequences of one width, are at most ``most`` edits apart.

    One banded table for all rows at once: column c holds the edits between the
    first i words of a and the first i + c - most of b.
    """
    n, width = a.shape
    if most == 0:
        return (a == b).all(axis=1)
    far = most + 1
    last = np.full((n, 2 * most + 1), far, np.int16)
    last[:, most:] = np.arange(most + 1)
    for i in range(1, width + 1):
        now = np.full_like(last, far)
        for c in range(2 * most + 1):
            j = i + c - most
            if not 0 <= j <= width:
                continue
            here = np.full(n, i, np.int16) if j == 0 else last[:, c] + (a[:, i - 1] != b[:, j - 1])
            if c + 1 < last.shape[1]:
                here = np.minimum(here, last[:, c + 1] + 1)
            if c and j:
                here = np.minimum(here, now[:, c - 1] + 1)
            now[:, c] = here
        last = now
    return last[:, most] <= most


@dataclass
class ItemIndex:
    """Windows of one block of items, ready to meet document windows."""

    width: int
    edits: int
    length: int
    bits: int
    seeds: list[int]
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, k.U))
    windows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), k.U))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def _views(symbols: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    return symbols[starts[:, None] + np.arange(width)[None, :]]


def _starts(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, text numbers) of all windows of ``width`` words inside one text."""
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][text]
    return first, text


def _pair_codes(words: np.ndarray) -> np.ndarray:
    return k.mix(words[:-1] * k.BASE_WORD + words[1:]) if len(words) > 1 else np.zeros(0, k.U)


def build_index(ids: np.ndarray, words: np.ndarray, bounds: np.ndarray, width: int, edits: int, repeats: int, length: int, bits: int) -> ItemIndex:
    """Index all windows of ``width`` words of the items; shorter items have none."""
    first, text = _starts(bounds, width)
    seeds = list(range(101, 101 + repeats))
    index = ItemIndex(width, edits, length, bits, seeds)
    index.windows = _views(words, width, first) if len(first) else np.zeros((0, width), k.U)
    index.owner = ids[text] if len(text) else np.zeros(0, np.int64)
    inner = np.ones(max(len(words) - 1, 0), bool)
    inner[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(words))] - 1] = False  # pairs across items
    index.pairs = np.unique(_pair_codes(words)[inner])
    for seed in seeds:
        codes = buckets(index.windows, seed, length, bits) if len(first) else np.zeros(0, k.U)
        order = np.argsort(codes, kind="stable")
        index.tables.append((codes[order], order))
    return index


def match(index: ItemIndex, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, item ids) of all verified leaks among ``texts``, without repeats."""
    none = np.zeros(0, np.int64)
    words, bounds = k.words(texts)
    w = index.width
    if len(words) < w or not len(index.windows):
        return none, none
    # A window within e edits of an item window keeps at least w - 1 - 2e of its word pairs.
    codes = _pair_codes(words)
    place = np.minimum(np.searchsorted(index.pairs, codes), len(index.pairs) - 1)
    known = np.concatenate(([0], np.cumsum(index.pairs[place] == codes)))
    first, text = _starts(bounds, w)
    near = (known[first + w - 1] - known[first]) >= max(w - 1 - 2 * index.edits, 0)
    first, text = first[near], text[near]
    if not len(first):
        return none, none
    windows = _views(words, w, first)
    doc_side, item_side = [], []
    for seed, (table, order) in zip(index.seeds, index.tables):
        here = buckets(windows, seed, index.length, index.bits)
        lo, hi = np.searchsorted(table, here, "left"), np.searchsorted(table, here, "right")
        n = hi - lo
        doc = np.repeat(np.arange(len(here)), n)
        doc_side.append(doc)
        item_side.append(order[np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + lo[doc]])
    d, i = np.concatenate(doc_side), np.concatenate(item_side)
    if not len(d):
        return none, none
    pairs = np.unique(d * len(index.windows) + i)
    d, i = pairs // len(index.windows), pairs % len(index.windows)
    good = np.zeros(len(d), bool)
    for at in range(0, len(d), 1 << 17):
        part = slice(at, at + (1 << 17))
        good[part] = within_edits(windows[d[part]], index.windows[i[part]], index.edits)
    hit = np.unique(np.stack((text[d[good]], index.owner[i[good]])), axis=1)
    return hit[0], hit[1]


def item_pieces(items: DataFrame, width: int, most: int) -> DataFrame:
    """(i, piece, n, words): the items' hashed words in pieces of at most ``most`` + width words.

    Neighbouring pieces overlap by width - 1 words, so every window is in one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = k.words(batch.column(1))
            rows = [(i, p, words[at : min(at + most + width - 1, b)]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))
                    for p, at in enumerate(range(a, b - width + 1, most))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()),
                     pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["i", "piece", "n", "words"])

    return items.mapInArrow(cut, f"i {items.schema['i'].dataType.simpleString()}, piece bigint, n bigint, words array<bigint>")


def leaks(documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, width: int = 12,
          edits: int = 0, repeats: int | None = None, length: int | None = None, bits: int | None = None,
          block_words: int | None = None) -> DataFrame:
    """(doc_id, item_id): documents holding ``width`` neighbouring words of an item.

    edits: word edits allowed within the window; 0 means verbatim words.
    repeats, bits, length: repetitions, sampled places and length of the walk. By
        default one repetition over few places at 0 edits (equal windows always
        meet), and 24 repetitions of 6 places otherwise.
    block_words: words of an item block, by default 500,000, or 50,000 with edits,
        whose index holds every repetition. Every block is one broadcast index and
        one pass over the documents, so a larger query set means more passes,
        never a larger broadcast; a long item is spread over blocks.

    Words are maximal runs of letters and digits in lower case. Null and empty
    texts match nothing; rows with null ids are dropped; repeated rows give one
    row. Documents are read whole; their windows never leave the task.
    """
    repeats = repeats or (24 if edits else 1)
    bits = bits or (6 if edits else 4)
    length = length or (2 * width if edits else 8)
    spark = documents.sparkSession
    query = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL AND length(t) > 0")
    block_words = block_words or (50_000 if edits else 500_000)
    id_type = documents.schema[doc_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    placed = materialise(prefix_sums(item_pieces(query, width, block_words), [], [F.col("i"), F.col("piece")], {"before": F.col("n")}), "items")
    blocks = (placed.agg(F.max("before")).first()[0] or 0) // block_words + 1
    out = None
    for b in range(blocks):
        rows = placed.filter(F.floor(F.col("before") / block_words) == b).select(F.col("i").cast("bigint"), "words").toPandas()
        words = np.concatenate([np.asarray(w, np.int64) for w in rows["words"]]).view(k.U) if len(rows) else np.zeros(0, k.U)
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in rows["words"]]))).astype(np.int64)
        index = build_index(rows["i"].to_numpy(np.int64), words, bounds, width, edits, repeats, length, bits)
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for piece in k.slices(batch.column(1)):
                    text, item = match(shared.value, piece)
                    if len(text):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + at)), pa.array(item)], names=["d", "i"])
                    at += len(piece)

        docs = documents.select(doc_id, doc_text).filter(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull())
        found = docs.mapInArrow(run, f"d {id_type}, i bigint")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("d").alias(doc_id), F.col("i").cast(item_type).alias(item_id)).distinct()
