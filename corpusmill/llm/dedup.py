"""Problem 2: duplicates hidden by formatting differences.

Every record is folded to a 128-bit fingerprint on the map side: code points go
through a skip-and-fold table, words and fields through rolling polynomial
hashes; canonical strings never exist. To find groups only (id, fingerprint) is
shuffled. The texts of records that share a fingerprint, and no others, then meet the
first record of their group, where a two-pointer comparison that skips formatting on
both sides verifies them; those that differ form a group of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmill.llm import kernel as k
from corpusmill.operators.latest import latest, salted_lookup
from corpusmill.runtime import broadcast_if_small, materialise

WORD = re.compile(r"[^\W_]+")
HOT_GROUP = 20_000


def _pair_hash(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each text's word sequence."""
    size = np.diff(bounds).astype(k.U)
    one = k.mix(k.span_hashes(words, bounds[:-1], bounds[1:], k.BASE_WORD) + size)
    two = k.mix(k.span_hashes(words, bounds[:-1], bounds[1:], k.BASE_WORD_2) ^ (size * k.BASE_CHAR))
    return one, two


def _entries(text: str | None) -> list[tuple[str, str]]:
    """(key in lower case, value as text) of a JSON object; null or blank has none.

    Text that isn't a JSON object is one entry under the empty key.
    """
    if text is None or not text.strip():
        return []
    try:
        value = json.loads(text)
    except ValueError:
        return [("", text)]
    if value is None:
        return []
    if not isinstance(value, dict):
        return [("", text)]
    plain = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return [(key.lower(), plain(v)) for key, v in value.items()]


def _object_hash(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each JSON object that don't depend on the order of its keys."""
    seen = column.dictionary_encode()
    each = [_entries(x) for x in seen.dictionary.to_pylist()]
    owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
    keys = np.array([int.from_bytes(_digest(key), "little") for x in each for key, _ in x], k.U)
    words, bounds = k.words(pa.array([v for x in each for _, v in x], pa.string()))
    out = []
    for n, values in enumerate(_pair_hash(words, bounds)):
        total = np.zeros(len(each) + 1, k.U)
        np.add.at(total, owner, k.mix(values * k.BASE_WINDOW + keys + k.U(n)))  # addition ignores order
        place = np.where(seen.indices.is_null().to_numpy(zero_copy_only=False), len(each),
                         seen.indices.fill_null(0).to_numpy(zero_copy_only=False))
        out.append(k.mix(total)[place])
    return out[0], out[1]


def _digest(key: str) -> bytes:
    from hashlib import blake2b

    return blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def fingerprints(df: DataFrame, keep: Sequence[str], texts: Sequence[str], objects: Sequence[str] = ()) -> DataFrame:
    """Add ``h1`` and ``h2``, equal for records that differ in formatting only.

    ``texts`` are compared by their words in order, each field by itself;
    ``objects`` hold JSON objects and are compared by key (case ignored, order
    ignored) and the words of each value. Null counts as empty. Only ``keep``,
    ``h1`` and ``h2`` come out; the texts stay where they were read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one = np.zeros(batch.num_rows, k.U)
            two = np.zeros(batch.num_rows, k.U)
            for field in texts:
                at = 0
                for part in k.slices(batch.column(field)):
                    a, b = _pair_hash(*k.words(part))
                    one[at : at + len(part)] = k.mix(one[at : at + len(part)] * k.BASE_WINDOW + a)
                    two[at : at + len(part)] = k.mix(two[at : at + len(part)] * k.BASE_WINDOW_2 + b)
                    at += len(part)
            for field in objects:
                a, b = _object_hash(batch.column(field))
                one, two = k.mix(one * k.BASE_WINDOW + a), k.mix(two * k.BASE_WINDOW_2 + b)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                names=[*keep, "h1", "h2"],
            )

    kept = df.select(*dict.fromkeys([*keep, *texts, *objects]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{schema}, h1 bigint, h2 bigint")


def same_words(a: str | None, b: str | None) -> bool:
    """Two pointers walk both texts, skipping formatting; no copy of either is made."""
    left, right = WORD.finditer(a or ""), WORD.finditer(b or "")
    for x, y in zip_longest(left, right):
        if x is None or y is None:
            return False
        x, y = x.group(), y.group()
        if x != y and x.lower() != y.lower():
            return False
    return True


def same_object(a: str | None, b: str | None) -> bool:
    """Same keys ignoring case and order, same words in each value."""
    if a == b:
        return True
    left, right = sorted(_entries(a)), sorted(_entries(b))
    return len(left) == len(right) and all(x[0] == y[0] and same_words(x[1], y[1]) for x, y in zip(left, right))


def hidden_duplicates(df: DataFrame, key: str, at: str | None, texts: Sequence[str], objects: Sequence[str] = (),
                      few: int = 1_000_000) -> DataFrame:
    """Members of each group of records that differ in formatting only.

    df: one row per ``key``, or, with ``at``, several states of a key of which
        the latest counts.
    Returns ``(first_id, copy_id)``: the smallest key of a group, and one row
    for each other member; records without a copy do not appear.

    Nulls and empty texts are equal to each other; a null key is left out, as no
    id could name it. An empty table gives an empty result. Other columns are
    ignored, whatever their names.

    A group may hold any share of all rows: grouping is a map-side combined
    ``min``, and members meet their first record in a join that is salted where a
    group is hot. Texts are read a second time for that; the list of members goes
    to the texts while it has at most ``few`` rows, so that no other text travels.
    Should fingerprints collide, what differs from its group's first record is
    grouped and verified anew until nothing differs.
    """
    stamp = [at] if at else []
    source = df.filter(F.col(key).isNotNull())
    marked = fingerprints(source, [key, *stamp], texts, objects)
    if at:
        marked = latest(marked, key, at, ["h1", "h2", at])
    marked = materialise(marked, "fingerprints")
    groups = marked.groupBy("h1", "h2").agg(F.min(key).alias("first_id"), F.count("*").alias("_n")).filter("_n > 1")
    members = salted_lookup(marked, materialise(groups, "groups"), ["h1", "h2"], F.col(key), "_n")
    members = members.select(F.col(key).alias("copy_id"), "first_id", "_n", *[F.col(c).alias("_at") for c in stamp])

    fields = [*texts, *objects]
    n_texts = len(texts)

    @pandas_udf("boolean")
    def verified(*columns: pd.Series) -> pd.Series:
        half = len(columns) // 2
        out = []
        for row in zip(*columns):
            out.append(all(
                (same_words if i < n_texts else same_object)(row[i], row[half + i]) for i in range(half)
            ))
        return pd.Series(out, dtype=bool)

    names = [f"_{i}" for i in range(len(fields))] + [f"_h{i}" for i in range(len(fields))]
    held = source.select(F.col(key).alias("_key"), *[F.col(c).alias("_was") for c in stamp], *[F.col(f).alias(f"_{i}") for i, f in enumerate(fields)])
    out = None
    while True:
        members = materialise(members, "members")
        on = [F.col("_key") == F.col("copy_id"), *([F.col("_was").eqNullSafe(F.col("_at"))] if at else [])]
        full = held.join(broadcast_if_small(members, few), on).drop("_key", "_was")
        heads = full.filter("copy_id = first_id").dropDuplicates(["first_id"]).select(
            "first_id", "_n", *[F.col(f"_{i}").alias(f"_h{i}") for i in range(len(fields))]
        )
        others = full.filter("copy_id <> first_id").drop("_n")
        largest = members.agg(F.max("_n")).first()[0] or 0
        if largest > HOT_GROUP:
            met = salted_lookup(others, materialise(heads, "heads"), ["first_id"], F.col("copy_id"), "_n")
        else:
            met = others.join(heads, "first_id")
        checked = materialise(met.select("first_id", "copy_id", *(["_at"] if at else []), verified(*names).alias("same")).distinct(), "verified")
        good = checked.filter("same").select("first_id", "copy_id")
        out = good if out is None else out.unionByName(good)
        rest = checked.filter("NOT same").drop("same")
        if rest.isEmpty():
            return out
        groups = rest.groupBy(F.col("first_id").alias("_g")).agg(F.min("copy_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        members = salted_lookup(rest.withColumnRenamed("first_id", "_g"), materialise(groups, "groups"), ["_g"], F.col("copy_id"), "_n")
        members = members.drop("_g").withColumnRenamed("_first", "first_id")


def collapse(df: DataFrame, key: str, at: str | None, texts: Sequence[str], objects: Sequence[str] = ()) -> DataFrame:
    """One row per distinct record: ``(first_id, copies)``, copies counting itself.

    Records without a copy have ``copies`` = 1. See :func:`hidden_duplicates`.
    """
    pairs = materialise(hidden_duplicates(df, key, at, texts, objects), "pairs")
    ids = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("first_id")).distinct()
    counted = pairs.groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
    firsts = ids.join(pairs.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return firsts.join(counted, "first_id", "left").select("first_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
