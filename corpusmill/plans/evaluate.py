"""How well retrieval works: known items, overlap, order, coverage, latency."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import build_query, word_tokens
from corpusmill.operators.fusion import overlap
from corpusmill.operators.search import batch_bm25, batch_scan
from corpusmill.operators.stats import document_frequency
from corpusmill.runtime import materialise

FIELDS = ("name", "description")
FILLER = ("please", "help me with")


def known_items(skills: DataFrame, n: int = 300, n_terms: int = 5, least: int = 80, seed: int = 7, df_range: tuple[int, int] = (20, 4000)) -> DataFrame:
    """(id, content_hash, query): seeded sample of documents with a query from their own mid-frequency words.

    A word is useful if between ``df_range`` documents have it; the useful words meet
    the sampled documents in a join, order by first place.
    """
    word = word_tokens(F.col("description"), r"[a-z][a-z0-9+#.-]{2,}")
    good = skills.filter((F.col("valid") == 1) & (F.length("description") >= least))
    useful = document_frequency(good, word).filter(F.col("df").between(*df_range)).select("term")
    drawn = good.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(3 * n)
    words = drawn.select("id", "content_hash", F.posexplode(F.array_distinct(word)).alias("p", "term")).join(useful, "term")
    lists = words.groupBy("id", "content_hash").agg(F.sort_array(F.collect_list(F.struct("p", "term"))).alias("_w"))
    queries = lists.select("id", "content_hash", build_query(F.col("_w.term"), None, n_terms).alias("query"))
    return queries.filter("query IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def rank_metrics(ranks: DataFrame, rank: str, at: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """One row: n, recall at each cut, mean reciprocal rank, median rank of those found (null rank: not found)."""
    r = F.col(rank)
    return ranks.agg(F.count("*").alias("n"), *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in at],
                     F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), F.expr(f"percentile({rank}, 0.5)").alias("median_rank"))


def known_item_ranks(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank): place of the first result that is the query's own document or a copy of it, null if not among ``k``.

    documents: (id, content_hash, name, description). queries: (qid, words, id,
    content_hash). All queries run in one batch.
    """
    return ranks_of(batch_scan(documents, "id", queries, k, FIELDS), documents, queries)


def ranks_of(hits: DataFrame, documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, rank) of results (qid, id, pos): the first that is the query's own document or a copy of it."""
    hits = hits.join(documents.select("id", F.col("content_hash").alias("_h")), "id")
    truth = queries.select("qid", F.col("id").alias("_id"), F.col("content_hash").alias("_t"))
    same = (F.col("id") == F.col("_id")) | F.coalesce((F.col("_h") == F.col("_t")) & (F.col("_t") != ""), F.lit(False))
    return truth.join(hits, "qid", "left").groupBy("qid").agg(F.min(F.when(same, F.col("pos"))).alias("rank"))


def gate_metrics(df: DataFrame, label: str, flagged: str) -> DataFrame:
    """One row: true and false positives and negatives, precision and recall of a gate on labelled rows."""
    a, b = F.col(label), F.col(flagged)
    counts = df.agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count_if(~a & ~b).alias("tn"))
    share = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y)))
    return counts.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def concordance(hits: DataFrame, query: str, pos: str, score: str, least: int = 4) -> DataFrame:
    """(query, concordance): share of a result list's pairs in which the better place has the higher score; ties are left out.

    Lists are results cut to a few rows, so their pairs are few.
    """
    big = hits.groupBy(query).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(query)
    rows = hits.join(big, query)
    a = rows.select(F.col(query), F.col(pos).alias("_p"), F.col(score).alias("_s"))
    b = rows.select(F.col(query), F.col(pos).alias("_p2"), F.col(score).alias("_s2"))
    pairs = a.join(b, query).filter("_p < _p2 AND _s <> _s2")
    return pairs.groupBy(query).agg(F.avg(F.when(F.col("_s") > F.col("_s2"), 1.0).otherwise(0.0)).alias("concordance"))


def variants(query: str) -> dict[str, str]:
    """The same query said otherwise: reordered, with filler, without its last word."""
    words = query.split()
    return {"reordered": " ".join(reversed(words)), "filler": f"{FILLER[0]} {FILLER[1]} {query}", "shortened": " ".join(words[:-1]) or query}


def batch_variants(words: Column) -> Column:
    """Array of (variant, words) of a query given as words: as it is, and as :func:`variants` says it."""
    filler = F.array(*[F.lit(w) for w in " ".join(FILLER).split()])
    shorter = F.when(F.size(words) > 1, F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    said = {"base": words, "reordered": F.reverse(words), "filler": F.concat(filler, words), "shortened": shorter}
    return F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("words")) for k, v in said.items()])


def variant_hits(documents: DataFrame, queries: DataFrame, k: int = 10, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(q, variant, id, pos): the first ``k`` results of each query (qid, words) as it is ("base") and of its variants, in one batch.

    index: (postings, stats) to answer from instead of the documents.
    """
    said = queries.select("qid", F.explode(batch_variants(F.col("words"))).alias("_v"))
    asked = said.select(F.struct(F.col("qid").alias("q"), F.col("_v.variant").alias("variant")).alias("qid"), "_v.words")
    hits = batch_bm25(*index, asked, k) if index else batch_scan(documents, "id", asked, k, FIELDS)
    return hits.select("qid.q", "qid.variant", "id", "pos")


def robustness(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(variant, n, overlap): how much of each query's first results its variants find as well, on average.

    hits: of :func:`variant_hits` for the same queries (qid, words).
    """
    sets = hits.groupBy("q", "variant").agg(F.collect_set("id").alias("ids"))
    base = sets.filter("variant = 'base'").select("q", F.col("ids").alias("_base"))
    said = queries.select(F.col("qid").alias("q"), F.explode(batch_variants(F.col("words"))).alias("_v")).select("q", "_v.variant")
    both = base.join(said.filter("variant <> 'base'"), "q").join(sets, ["q", "variant"], "left")
    share = overlap(F.col("_base"), F.coalesce("ids", F.array().cast(sets.schema["ids"].dataType)))
    return both.groupBy("variant").agg(F.count("*").alias("n"), F.avg(share).alias("overlap"))


def suite(documents: DataFrame, queries: DataFrame, k: int = 10, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(measure, value): the whole evaluation of keyword retrieval, one row a measure.

    documents: (id, content_hash, category, name, description). queries: (qid, words,
    id, content_hash, category). Known items (recall and reciprocal rank), coverage
    (share of queries that find nothing), coherence (share of hits of the query's
    own category) and robustness (overlap of each variant).
    """
    found = materialise(variant_hits(documents, queries, k, index), "hits")
    hits = found.filter("variant = 'base'").select(F.col("q").alias("qid"), "id", "pos")
    ranks = rank_metrics(ranks_of(hits, documents, queries), "rank")
    known = ranks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
                                             for c in ("n", "recall_1", "recall_3", "recall_5", "recall_10", "mrr")])).alias("_m")).select("_m.*")
    counts = queries.select("qid").join(hits.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    empty = coverage(counts.withColumn("n", F.coalesce("n", F.lit(0))), "n").select(F.lit("empty").alias("measure"), F.col("empty").alias("value"))
    kinds = hits.join(documents.select("id", F.col("category").alias("_c")), "id").join(queries.select("qid", "category").filter("category <> ''"), "qid")
    own = coherence(kinds, "category", "_c").agg(F.lit("coherence").alias("measure"), F.avg("coherence").alias("value"))
    held = robustness(found, queries).select(F.concat(F.lit("robust_"), "variant").alias("measure"), F.col("overlap").alias("value"))
    return known.unionByName(empty).unionByName(own).unionByName(held)


def mean_overlap(base: Column, other: Column) -> Column:
    """Share of the base list that the other list has."""
    return overlap(base, other)


def coverage(counts: DataFrame, n: str) -> DataFrame:
    """One row: share of queries without a hit, and with one or two."""
    return counts.agg(F.avg(F.when(F.col(n) == 0, 1.0).otherwise(0.0)).alias("empty"), F.avg(F.when(F.col(n).between(1, 2), 1.0).otherwise(0.0)).alias("thin"))


def latency(run: Callable[[str], DataFrame], queries: Sequence[str]) -> dict[str, float]:
    """Seconds of each query after one warm run: p50, p90, p99, max."""
    run(queries[0]).collect()
    took = []
    for q in queries:
        began = time.perf_counter()
        run(q).collect()
        took.append(time.perf_counter() - began)
    took.sort()
    pick = lambda p: took[min(len(took) - 1, int(p * len(took)))]
    return {"p50": pick(0.5), "p90": pick(0.9), "p99": pick(0.99), "max": took[-1]}


def coherence(hits: DataFrame, expected: str, category: str) -> DataFrame:
    """(expected, coherence): share of the hits of a label's query that lie in its category."""
    return hits.groupBy(expected).agg(F.avg(F.when(F.col(category) == F.col(expected), 1.0).otherwise(0.0)).alias("coherence"))
