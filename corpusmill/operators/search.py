"""Full-text search: an inverted index as tables, BM25, facets and counts.

The index is two tables: ``postings`` (term, id, field, tf, positions) and
``stats`` (id, dl), written once and read by every query; a query reads only the
terms it matches (Parquet statistics on the sorted ``term`` prune the rest).
:func:`match_scan` gives the same matches from the texts themselves, in one pass
without a shuffle, for corpora that have no index.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import compile_query, folded, phrase_hits, tokens
from corpusmill.operators.batch import best_documents
from corpusmill.runtime import spread, tasks_for

# Weights of the fields in BM25, and its constants.
FIELD_WEIGHTS = {"name": 10.0, "description": 6.0, "body": 1.0, "repo": 2.0, "path": 1.5}
K1, B = 1.2, 0.75
CONJUNCTIVE_FLOOR = 25


def build_index(df: DataFrame, key: str, fields: Sequence[str] = tuple(FIELD_WEIGHTS)) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of a table of documents.

    postings: (term, id, field, tf, positions). stats: (id, dl), dl counting the
    words of all fields; documents without a word have a row with dl 0.
    Terms of one document are counted inside its row, so that nothing is shuffled
    until the index is written sorted by term.
    """
    words = df.select(F.col(key).alias("id"), *[tokens(F.col(f)).alias(f) for f in fields])
    stats = words.select("id", sum((F.size(f) for f in fields), F.lit(0)).cast("bigint").alias("dl"))
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(names):
                lists = batch.column(i + 1)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                if not size.sum():
                    continue
                seen = lists.flatten().dictionary_encode()
                code = seen.indices.to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                order = np.lexsort((place, code, row))
                row, code, place = row[order], code[order], place[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
                bounds = np.append(first, len(row))
                yield pa.RecordBatch.from_arrays(
                    [seen.dictionary.take(pa.array(code[first])), batch.column(0).take(pa.array(row[first])), pa.array([name] * len(first), pa.string()),
                     pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place, pa.int32()))],
                    names=["term", "id", "field", "tf", "positions"])

    id_type = df.schema[key].dataType.simpleString()
    return words.mapInArrow(count, f"term string, id {id_type}, field string, tf bigint, positions array<int>"), stats


def write_index(df: DataFrame, key: str, path: str, fields: Sequence[str] = tuple(FIELD_WEIGHTS)) -> None:
    """Build the index and write it below ``path``, postings partitioned by term and sorted by it in every file.

    Partitions come from hashes, as ranges would be drawn by reading all texts once
    more; a term that most documents have lies in up to 32 of them.
    """
    postings, stats = build_index(df, key, fields)
    placed = postings.repartition(tasks_for(df, 32 << 20), F.col("term"), F.pmod(F.xxhash64("id"), F.lit(32)))
    placed.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def update_index(postings: DataFrame, stats: DataFrame, changed: DataFrame, key: str, gone: DataFrame | None = None,
                 fields: Sequence[str] = tuple(FIELD_WEIGHTS)) -> tuple[DataFrame, DataFrame]:
    """The index after documents changed or went: their old entries leave, new ones come."""
    ids = changed.select(F.col(key).alias("id"))
    ids = ids.unionByName(gone.select(F.col(key).alias("id"))) if gone is not None else ids
    new_postings, new_stats = build_index(changed, key, fields)
    return (postings.join(ids, "id", "left_anti").unionByName(new_postings), stats.join(ids, "id", "left_anti").unionByName(new_stats))


def _term_filter(phrases: Sequence[tuple[list[str], bool]]) -> Column:
    out = F.lit(False)
    for phrase, prefix in phrases:
        for i, part in enumerate(phrase):
            last = prefix and i == len(phrase) - 1
            out = out | (F.col("term").startswith(part) if last else F.col("term") == part)
    return out


def match_index(postings: DataFrame, query: str, weights: Mapping[str, float] = FIELD_WEIGHTS) -> tuple[DataFrame, int]:
    """((id, f), number of query terms): f[i] is the weighted hit count of query term i, 0 if none.

    Single words are sums over their postings. A phrase meets by its words'
    positions, field by field. Only documents with some hit appear.
    """
    phrases, _ = compile_query(query)
    wanted = postings.filter(_term_filter(phrases)) if phrases else postings.filter(F.lit(False))
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    parts = []
    for i, (phrase, prefix) in enumerate(phrases):
        met = lambda j: F.col("term").startswith(phrase[j]) if prefix and j == len(phrase) - 1 else F.col("term") == phrase[j]  # noqa: B023, E731
        if len(phrase) == 1:
            parts.append(wanted.filter(met(0)).select("id", F.lit(i).alias("i"), (F.col("tf") * F.coalesce(weight[F.col("field")], F.lit(0.0))).alias("w")))
            continue
        rows = None
        for j in range(len(phrase)):
            one = wanted.filter(met(j)).select("id", "field", F.explode("positions").alias("p")).select("id", "field", (F.col("p") - j).alias("p")).distinct()
            rows = one if rows is None else rows.join(one, ["id", "field", "p"])
        parts.append(rows.select("id", F.lit(i).alias("i"), F.coalesce(weight[F.col("field")], F.lit(0.0)).alias("w")))
    if not parts:
        return postings.select("id", F.array().cast("array<double>").alias("f")).filter(F.lit(False)), 0
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    per_doc = hits.groupBy("id").agg(*[F.sum(F.when(F.col("i") == i, F.col("w")).otherwise(0.0)).alias(f"_f{i}") for i in range(len(phrases))])
    return per_doc.select("id", F.array(*[f"_f{i}" for i in range(len(phrases))]).alias("f")), len(phrases)


def match_scan(df: DataFrame, key: str, query: str, keep: Sequence[str] = (), weights: Mapping[str, float] = FIELD_WEIGHTS) -> tuple[DataFrame, int]:
    """((id, f, dl, keep...), number of query terms) of every document, from its texts, in one pass."""
    phrases, _ = compile_query(query)
    df = spread(df.select(*dict.fromkeys([key, *keep, *weights])))
    words = df.select(F.col(key).alias("id"), *keep, *[folded(F.col(f)).alias(f"_t_{f}") for f in weights])
    f = [sum((F.lit(float(w)) * phrase_hits(F.col(f"_t_{name}"), p, prefix) for name, w in weights.items()), F.lit(0.0)) for p, prefix in phrases]
    dl = sum((F.regexp_count(F.col(f"_t_{name}"), F.lit(r"[\p{L}\p{N}]+")) for name in weights), F.lit(0)).cast("bigint")
    return words.select("id", *keep, (F.array(*f) if f else F.array().cast("array<double>")).alias("f"), dl.alias("dl")), len(phrases)


def matches(conjunctive: bool) -> Column:
    """Whether a row of hit counts ``f`` matches: all terms, or any."""
    hit = lambda x: x > 0
    return (F.size("f") > 0) & (F.forall("f", hit) if conjunctive else F.exists("f", hit))


def bm25(matched: DataFrame, n_terms: int, corpus: tuple[int, float] | None = None) -> DataFrame:
    """Add ``bm25`` (higher is better) to rows (id, f, dl, ...).

    corpus: number of documents and their average length, by default those of
        ``matched``, which then holds all documents; with it only those that match
        any term need be there. Document frequencies are counted over ``matched``.
    What is counted is one row, which is broadcast.
    Term frequencies are the weighted hits of all fields, lengths the words of all
    fields; the weight of a term in nearly every document is floored at 1e-6.
    """
    df_i = [F.count_if(F.get("f", F.lit(i)) > 0).alias(f"_n{i}") for i in range(n_terms)]
    totals = matched.agg(F.count("*").alias("_N"), F.avg("dl").alias("_avg"), *df_i)
    if corpus is not None:
        totals = totals.withColumn("_N", F.lit(corpus[0])).withColumn("_avg", F.lit(corpus[1]))
    rows = matched.crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(n_terms):
        n, tf = F.col(f"_n{i}"), F.get("f", F.lit(i))
        idf = F.log((F.col("_N") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        norm = F.lit(K1) * (1 - B + F.lit(B) * F.col("dl") / F.col("_avg"))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    return rows.withColumn("bm25", score).drop("_N", "_avg", *[f"_n{i}" for i in range(n_terms)])


def choose(rows: DataFrame, floor: int = CONJUNCTIVE_FLOOR) -> DataFrame:
    """The rows that match all terms if these are at least ``floor``, else those that match any."""
    mode = rows.agg((F.count_if(matches(True)) >= floor).alias("_both"))  # one row
    return rows.crossJoin(F.broadcast(mode)).filter(F.when(F.col("_both"), matches(True)).otherwise(matches(False))).drop("_both")


def top_k(rows: DataFrame, score: str, k: int, tie: str = "id") -> DataFrame:
    """The best ``k`` rows; ties go to the smaller key."""
    return rows.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)


def count_matches(rows: DataFrame, floor: int = CONJUNCTIVE_FLOOR) -> DataFrame:
    """One row ``matches``: those of all terms if at least ``floor``, else of any."""
    both = rows.agg(F.count_if(matches(True)).alias("_all"), F.count_if(matches(False)).alias("_any"))
    return both.select(F.when(F.col("_all") >= floor, F.col("_all")).otherwise(F.col("_any")).alias("matches"))


def facets(rows: DataFrame, dimensions: Sequence[str], top: int = 10) -> DataFrame:
    """(facet, value, n): the ``top`` values of each dimension, all from one pass over the rows.

    Null and empty values don't count; ties go to the smaller value.
    """
    each = F.array(*[F.struct(F.lit(d).alias("facet"), F.col(d).cast("string").alias("value")) for d in dimensions])
    counts = rows.select(F.explode(each).alias("_x")).select("_x.facet", "_x.value").filter("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), F.col("value")))
    return counts.withColumn("_r", place).filter(F.col("_r") <= top).drop("_r")


def vector_top_k(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int | None, least: float = 0.05) -> DataFrame:
    """(key, similarity): the ``k`` nearest rows (all if None) by cosine above ``least``, by an exact scan."""
    from corpusmill.functions.vectors import cosine

    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(key, cosine(F.col(vector), q).alias("similarity")).filter(F.col("similarity") > least)
    return scored if k is None else scored.orderBy(F.col("similarity").desc(), F.col(key)).limit(k)


def batch_bm25(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int, weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """(qid, id, bm25, pos): the best ``k`` documents of each of many queries (qid, words), whole words only.

    Postings gather by document, then see :func:`best_documents`. Queries without a
    match do not appear; ties go to the smaller id.
    """
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    each = F.struct("term", (F.col("tf") * F.coalesce(weight[F.col("field")], F.lit(0.0))).alias("w"))
    rows = postings.groupBy("id").agg(F.collect_list(each).alias("_t")).join(stats, "id", "right")
    return best_documents(rows.select("id", "dl", F.col("_t.term").alias("words"), F.col("_t.w").alias("w")), queries, k, K1, B)


def batch_scan(df: DataFrame, key: str, queries: DataFrame, k: int, fields: Sequence[str] = tuple(FIELD_WEIGHTS), weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """What :func:`batch_bm25` gives, from the documents themselves: no index is built and no posting shuffled."""
    lists = df.select(F.col(key).alias("id"), *[tokens(F.col(f)).alias(f"_t_{f}") for f in fields])
    w = F.concat(*[F.array_repeat(F.lit(float(weights.get(f, 0.0))), F.size(f"_t_{f}")) for f in fields])
    words = F.concat(*[F.col(f"_t_{f}") for f in fields])
    dl = sum((F.size(f"_t_{f}") for f in fields), F.lit(0)).cast("bigint")
    return best_documents(lists.select("id", dl.alias("dl"), words.alias("words"), w.alias("w")), queries, k, K1, B)


def vector_search(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 1024, chunk: int = 2048) -> DataFrame:
    """(qid, key, similarity, pos): exact ``k`` nearest rows by cosine for each of many queries (qid, vector).

    The queries are taken in blocks of at most ``block`` rows, each block one
    broadcast matrix and one pass over the rows: a matrix product for every ``chunk``
    rows, so a task holds block x chunk similarities at most, of which only the best
    k a query and task go on. Null, empty and zero vectors are
    similar to nothing; vectors of another length than the block's are left out.
    Similarities are compared to 9 decimals, ties go to the smaller key.
    """
    spark = df.sparkSession
    asked = queries.select("qid", "vector").filter(F.size("vector") > 0)
    parts = max(1, -(-asked.count() // block))
    key_type = df.schema[key].dataType.simpleString()
    out = None
    for p in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p).collect()
        if not rows:
            continue
        dim = len(rows[0]["vector"])
        rows = [r for r in rows if len(r["vector"]) == dim]
        m = np.array([r["vector"] for r in rows], np.float64)
        norms = np.linalg.norm(m, axis=1)
        m, ids = m[norms > 0] / norms[norms > 0, None], np.array([r["qid"] for r in rows])[norms > 0]
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # query number, similarity, key
            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    part = batch.slice(at, chunk)
                    column = part.column(1)
                    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    good = np.flatnonzero(size == dim)
                    x = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    n = np.linalg.norm(x, axis=1)
                    good, x, n = good[n > 0], x[n > 0], n[n > 0]
                    if not len(good) or not len(m):
                        continue
                    keys = part.column(0).take(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64)
                    sims = np.round(m @ (x / n[:, None]).T, 9)
                    least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(m), -np.inf)
                    q, j = np.nonzero(sims >= least[:, None])  # the k-th best and all that equal it
                    q, s, kk = np.concatenate((best[0], q)), np.concatenate((best[1], sims[q, j])), np.concatenate((best[2], keys[j]))
                    order = np.lexsort((kk, -s, q))
                    q, s, kk = q[order], s[order], kk[order]
                    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                    best = q[kept], s[kept], kk[kept]
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["qid", "k", "s"])

        found = df.select(key, vector).filter(F.col(key).isNotNull() & (F.size(vector) > 0)).mapInArrow(run, "qid bigint, k bigint, s double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "qid bigint, k bigint, s double")
    placed = out.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("s").desc(), "k")))
    return placed.filter(F.col("pos") <= k).select("qid", F.col("k").cast(key_type).alias(key), F.col("s").alias("similarity"), "pos")
