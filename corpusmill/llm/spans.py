"""Problem 10: long exact spans shared between records.

The anchor of a window of ``run`` characters is the least hash of its shorter inner
windows, so neighbouring windows mostly share one and a text has few. A count-min
sketch, split by anchor range and merged from what the partitions counted, over-
estimates in how many texts an anchor lies; only windows whose anchor is estimated
in two or more are ever grouped, so none that is shared is lost, and these are
grouped exactly.

Not every position of a shared stretch has to be grouped: windows chosen by their
own content (one in ``SAMPLE``) are grouped first and cover most of each stretch.
What remains are its edges: anchors that still have windows outside of what is
covered. Every text that has such an anchor sends all its windows of it, and these
are grouped exactly as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernel as k
from corpusmill.operators.latest import salted_lookup
from corpusmill.runtime import cores, materialise

DEPTH = 4
SAMPLE = 32
OWNED = 8_000_000  # anchors a task owns, about
COUNTED = 1 << 20  # anchors that share one sketch, about
SMALL_LISTS, SMALL_ENTRIES = 200_000, 2_000_000


@lru_cache(maxsize=1)
def raw_symbols() -> np.ndarray:
    """Per code point a random-looking 64-bit symbol; nothing is folded."""
    return k.mix(np.arange(0x110000, dtype=k.U) + k.U(0x1234567))


def inner_width(run: int) -> int:
    """Width of the inner windows whose least hash is a window's anchor.

    Wider ones mean fewer unshared windows that hang over the end of a shared
    stretch with its anchor, and more anchors a text.
    """
    return max(1, run * 2 // 3)


def cell(values: np.ndarray, row: int, log: int) -> np.ndarray:
    """Cell of each value in a row of a sketch."""
    return (k.mix(values + k.U(row * 0x51ED270B)) >> k.U(64 - log)).astype(np.int64)


def repeated(anchors: np.ndarray, texts: np.ndarray, log: int) -> np.ndarray:
    """Whether a count-min sketch of (anchor, texts) rows estimates two texts or more for each row's anchor."""
    out = np.ones(len(anchors), bool)
    for row in range(DEPTH):
        at = cell(anchors, row, log)
        counts = np.bincount(at, minlength=1 << log) + np.bincount(at[texts > 1], minlength=1 << log)  # more than two count as two
        out &= counts[at] > 1
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, n): anchors of a task, pieces of it added up, so that a hot one arrives once a piece at its owner."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        rows += len(held[-1])
        if rows >= 2 * COUNTED:
            yield _added(held)
            held, rows = [], 0
    if rows:
        yield _added(held)


def _added(held: list[np.ndarray]) -> pa.RecordBatch:
    a, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(n.astype(np.int32))], names=["a", "n"])


def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, n): an owner's anchors that its sketches estimate in two or more texts, and in how many rows they came.

    What one task owns is cut into ranges of about ``COUNTED`` anchors, each with a
    sketch of four to eight cells an anchor.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    a = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in parts]).view(k.U)
    n = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in parts])
    ranges = -(-len(a) // COUNTED)
    which = k.mix(a ^ k.BASE_WORD_2) % k.U(ranges)
    for r in range(ranges):
        here = np.flatnonzero(which == r) if ranges > 1 else np.arange(len(a))
        log = max(10, int(4 * len(here)).bit_length())
        here = here[repeated(a[here], n[here], log)]
        if len(here):
            found, place = np.unique(a[here], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(np.bincount(place, n[here]).astype(np.int64))], names=["a", "n"])


class Windows:
    """All windows of ``run`` characters of a slice of texts, by anchor."""

    def __init__(self, texts: pa.Array, run: int):
        points, offsets = k.code_points(texts)
        self.run, n = run, len(points)
        inner = inner_width(run)
        size = np.diff(offsets)
        self.any = n >= run and bool((size >= run).any())
        if not self.any:
            return
        symbols = np.take(raw_symbols(), points)
        self.sums = np.zeros(n + 1, k.U)
        np.cumsum(symbols * k.powers(k.BASE_CHAR, n), out=self.sums[1:])
        self.symbols = symbols
        hashes = (self.sums[inner:] - self.sums[:-inner]) * k.powers(k.inverse(k.BASE_CHAR), n + 1)[: n + 1 - inner]
        least = k.sliding_min(hashes * k.BASE_WORD, run - inner + 1)
        text = np.repeat(np.arange(len(size)), np.maximum(size - run + 1, 0))
        first = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(size - run + 1, 0)) - np.maximum(size - run + 1, 0),
                                                 np.maximum(size - run + 1, 0)) + offsets[:-1][text]
        anchor = least[first]
        head = np.ones(len(first), bool)
        head[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        self.first, self.text, self.offsets = first, text, offsets
        self.heads = np.flatnonzero(head)
        self.anchors = anchor[self.heads]
        self.counts = np.diff(np.append(self.heads, len(first)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, anchor) pairs, each once."""
        order = np.lexsort((self.anchors, self.text[self.heads]))
        a, t = self.anchors[order], self.text[self.heads][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
        return t[new], a[new]

    def listed(self, lists: list[np.ndarray]) -> np.ndarray:
        """Which of ``heads`` have an anchor that is in their own text's list."""
        on = np.zeros(len(self.heads), bool)
        owner = self.text[self.heads]
        bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
        for i, known in enumerate(lists):
            a, b = bounds[i], bounds[i + 1]
            if b > a and len(known):
                on[a:b] = np.isin(self.anchors[a:b], known)
        return on

    def windows(self, on: np.ndarray) -> np.ndarray:
        """Indexes of all windows under the heads marked in ``on``."""
        return np.flatnonzero(np.repeat(on, self.counts))

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each of the windows ``which``."""
        at = self.first[which]
        one = (self.sums[at + self.run] - self.sums[at]) * k.powers(k.inverse(k.BASE_CHAR), len(self.sums))[at]
        return k.mix(one), self._second(at)

    def _second(self, at: np.ndarray) -> np.ndarray:
        if not hasattr(self, "sums2"):
            n = len(self.symbols)
            self.sums2 = np.zeros(n + 1, k.U)
            np.cumsum((self.symbols ^ k.BASE_WINDOW) * k.powers(k.BASE_WINDOW_2, n), out=self.sums2[1:])
        return k.mix((self.sums2[at + self.run] - self.sums2[at]) * k.powers(k.inverse(k.BASE_WINDOW_2), len(self.sums2))[at])


def _rows(column: pa.Array, run: int) -> Iterator[tuple[int, Windows]]:
    """(number of the slice's first text, its windows) for every slice with windows."""
    at = 0
    for piece in k.slices(column):
        w = Windows(piece, run)
        if w.any:
            yield at, w
        at += len(piece)


HIT_SCHEMA = ["d", "pos", "h1", "h2"]


def _hits(ids: pa.Array, base: int, w: Windows, which: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    text = w.text[which]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(text + base)), pa.array(w.first[which] - w.offsets[text]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
        names=HIT_SCHEMA)


def _lists(column: pa.Array, base: int, n: int) -> list[np.ndarray]:
    """The anchors of n rows of a list column."""
    return [np.asarray(x, np.int64).view(k.U) for x in column.slice(base, n).to_pylist()]


def _shared(hits: DataFrame) -> DataFrame:
    """Exact grouping: (d, pos) of windows that lie in at least two different texts."""
    groups = hits.groupBy("h1", "h2").agg(F.min("d").alias("_a"), F.max("d").alias("_b"), F.count("*").alias("_n"))
    groups = materialise(groups.filter("_a <> _b").select("h1", "h2", "_n"), "shared")
    return salted_lookup(hits, groups, ["h1", "h2"], F.col("pos"), "_n").select("d", "pos")


def _holding(known: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows (d, a) of ``known`` whose anchor is in ``anchors`` (a, n)."""
    if anchors.count() <= SMALL_ENTRIES:
        return known.join(F.broadcast(anchors.select("a")), "a").select("d", "a")
    return salted_lookup(known, anchors, ["a"], F.col("d"), "n").select("d", "a")


def _meet(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(d, t, anchors): texts with their own anchors out of rows (d, a); texts without any are left out.

    The lists go to the texts while they are few, which is counted; beyond that
    those texts go to their lists.
    """
    lists = materialise(rows.groupBy("d").agg(F.collect_set("a").alias("anchors")), "lists")  # at most a text's own anchors
    n, entries = lists.agg(F.count("*"), F.sum(F.size("anchors"))).first()
    few = n <= SMALL_LISTS and (entries or 0) <= SMALL_ENTRIES
    return docs.join(F.broadcast(lists) if few else lists, "d").select("d", "t", "anchors")


def _stretches(windows: DataFrame, key: str, d_type: str, run: int) -> DataFrame:
    """Maximal stretches that a text's shared windows (d, pos) cover."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, at in enumerate(batch.column(1).to_pylist()):
                p = np.asarray(at, np.int64)
                s, e = k.merge_spans(p, p + run)
                ids += [i] * len(s)
                starts.append(s)
                ends.append(e)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))],
                                                 names=[key, "start_pos", "end_pos"])

    per_text = windows.groupBy("d").agg(F.collect_set("pos").alias("at"))  # at most the text's length
    return per_text.mapInArrow(join, f"`{key}` {d_type}, start_pos bigint, end_pos bigint")


def _open_anchors(runs: DataFrame, covered: DataFrame, run: int) -> DataFrame:
    """(a, n): anchors with windows outside of what is covered in some text, and in how many rows.

    runs: (d, a, lo, hi), the windows at positions lo..hi-1 of a text have anchor a.
    """

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for a, lo, hi, at in zip(*[c.to_pylist() for c in batch.columns]):
                a, lo, hi = np.asarray(a, np.int64), np.asarray(lo, np.int64), np.asarray(hi, np.int64)
                p = np.sort(np.asarray(at or [], np.int64))
                s, e = k.merge_spans(p, p + run)
                if len(s):
                    place = np.searchsorted(s, lo, "right") - 1
                    a = a[(place < 0) | (hi - 1 + run > e[np.maximum(place, 0)])]
                held.append(np.unique(a))
            if held:
                yield _added(held)

    per_text = runs.groupBy("d").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("r")).join(
        covered.groupBy("d").agg(F.collect_list("pos").alias("at")), "d", "left")  # both at most a text's length
    found = per_text.select(F.col("r.a").alias("a"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), "at").mapInArrow(outside, "a bigint, n int")
    return found.groupBy("a").agg(F.sum("n").alias("n"))


def shared_spans(df: DataFrame, key: str, text: str, run: int = 300) -> DataFrame:
    """(key, start_pos, end_pos): each maximal stretch of a text in which every
    character lies in some run of ``run`` characters that also occurs, exactly, in
    the text of another key.

    Positions count code points, the end is exclusive; stretches that overlap or
    touch are one. Null, empty and shorter texts have none; rows with a null key
    are dropped; rows repeating a key count as the same text's. Texts are read
    whole. Windows are grouped by 128 bits of hash.

    All sizes take the same way. The sketch has about six cells an anchor, whatever
    their number, and never leaves the task that owns its range; a fuller one would
    overestimate more, which costs windows that are grouped and never a result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("d"), F.col(text).alias("t")).filter(F.col("d").isNotNull() & (F.length("t") >= run))
    d_type = df.schema[key].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, w in _rows(batch.column(1), run):
                t, a = w.distinct()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t + base)), pa.array(a.view(np.int64))], names=["d", "a"])

    anchors = materialise(docs.mapInArrow(emit, f"d {d_type}, a bigint"), "anchors")
    owners = max(cores(spark), -(-anchors.count() // OWNED))
    found = anchors.select("a").mapInArrow(counted, "a bigint, n int").repartition(owners, "a").mapInArrow(estimated, "a bigint, n bigint")
    known = materialise(_holding(anchors, materialise(found, "repeated")), "known")
    open_docs = materialise(_meet(docs, known), "open")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, w in _rows(batch.column(1), run):
                on = w.listed(_lists(batch.column(2), base, len(w.offsets) - 1))
                which = w.windows(on)
                if not len(which):
                    continue
                one, two = w.hashes(which)
                chosen = one % k.U(SAMPLE) == 0
                yield _hits(batch.column(0), base, w, which[chosen], one[chosen], two[chosen])
                head = w.heads[on]  # h1 and h2 of a head are where its windows begin and end; pos tells them from hits
                owner = w.text[head]
                lo = w.first[head] - w.offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + base)), pa.array(-1 - lo), pa.array(w.anchors[on].view(np.int64)), pa.array(lo + w.counts[on])],
                    names=HIT_SCHEMA)

    hits = materialise(open_docs.mapInArrow(sampled, f"d {d_type}, pos bigint, h1 bigint, h2 bigint"), "sampled")
    covered = materialise(_shared(hits.filter("pos >= 0")), "covered")
    runs = hits.filter("pos < 0").select("d", F.col("h1").alias("a"), (-1 - F.col("pos")).alias("lo"), F.col("h2").alias("hi"))
    edges = _holding(known, materialise(_open_anchors(runs, covered, run), "edges"))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, w in _rows(batch.column(1), run):
                which = w.windows(w.listed(_lists(batch.column(2), base, len(w.offsets) - 1)))
                if len(which):
                    yield _hits(batch.column(0), base, w, which, *w.hashes(which))

    rest = materialise(_meet(open_docs.select("d", "t"), edges).mapInArrow(answers, f"d {d_type}, pos bigint, h1 bigint, h2 bigint"), "answers")
    return _stretches(covered.unionByName(_shared(rest)), key, d_type, run)


def shared_amount(df: DataFrame, key: str, text: str, run: int = 300) -> DataFrame:
    """(key, shared_chars, share): how much of each text is shared elsewhere; 0 rows too.

    The share of an empty or null text is 0.
    """
    amount = shared_spans(df, key, text, run).groupBy(key).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("_n"))
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("_len"))
    both = sizes.join(amount, key, "left").withColumn("shared_chars", F.coalesce("_n", F.lit(0)).cast("bigint"))
    return both.select(key, "shared_chars", F.when(F.col("_len") > 0, F.col("shared_chars") / F.col("_len")).otherwise(0.0).alias("share"))
