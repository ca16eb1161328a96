"""Batched searches: the best documents of many queries, without looking at all of them."""

import math
from collections import Counter

import numpy as np
import pytest

from corpusmill.operators import batch as bt
from corpusmill.operators import search as sr
from corpusmill.plans import evaluate as ev

COLUMNS = "id int, name string, description string"


def _documents(n, seed=5):
    """Texts of a few common and many rare words, some repeated, some empty."""
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    out = []
    for i in range(n):
        text = lambda least, most: " ".join(r.choice(words, r.integers(least, most), p=p / p.sum()))  # noqa: B023, E731
        out.append((i, text(0, 3), None if i % 17 == 0 else text(1, 12)) if i % 9 or not out else (i, *out[-1][1:]))
    return out


def _plainly(docs, queries, k):
    """The same results by scoring every document."""
    f, dl = {}, {}
    for i, *texts in docs:
        f[i] = Counter()
        for text, w in zip(texts, (10.0, 6.0), strict=True):
            for x in (text or "").split():
                f[i][x] += w
        dl[i] = sum(len((t or "").split()) for t in texts)
    n, average = Counter(x for c in f.values() for x in c), sum(dl.values()) / len(docs)
    idf = {x: math.log((len(docs) - m + 0.5) / (m + 0.5)) for x, m in n.items()}
    out = set()
    for qid, words in queries:
        s = {i: round(sum((idf[x] if idf[x] > 0 else 1e-6) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * dl[i] / average)) for x in set(words) if c[x]), 9) for i, c in f.items() if any(c[x] for x in words)}
        out |= {(qid, i, pos + 1) for pos, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:k])}
    return out


QUERIES = [(1, ["w0", "w1", "w40"]), (2, ["w55", "w50", "w3", "w0", "w0"]), (3, ["w0"]), (4, ["nowhere"]), (5, []), (6, ["w40", "w1", "w0"]), (7, None), (8, ["w30", "nowhere", None])]


@pytest.mark.parametrize(("block", "at_once"), [(32_768, 65_536), (7, 2)])
def test_batch_is_exact(spark, monkeypatch, block, at_once):
    docs = _documents(120)
    df, asked = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(QUERIES, "qid int, words array<string>")
    whole = bt.best_documents
    monkeypatch.setattr(sr, "best_documents", lambda *a: whole(*a, block=block, at_once=at_once))
    want = _plainly(docs, [(q, [x for x in words or [] if x]) for q, words in QUERIES], 4)
    assert {(r["qid"], r["id"], r["pos"]) for r in sr.batch_scan(df, "id", asked, 4, ev.FIELDS).collect()} == want
    assert {(r["qid"], r["id"], r["pos"]) for r in sr.batch_bm25(*sr.build_index(df, "id", ev.FIELDS), asked, 4).collect()} == want


def test_no_documents_and_text_keys(spark):
    asked = spark.createDataFrame([("q", ["pdf"])], "qid string, words array<string>")
    empty = spark.createDataFrame([], "id string, name string, description string")
    assert sr.batch_scan(empty, "id", asked, 3, ev.FIELDS).count() == 0
    docs = spark.createDataFrame([("b", "pdf", ""), ("a", "pdf", ""), (None, "pdf", ""), ("c", "", "other")] + [(f"x{i}", "", "none") for i in range(9)], "id string, name string, description string")
    assert [tuple(r) for r in sr.batch_scan(docs, "id", asked, 3, ev.FIELDS).orderBy("pos").select("qid", "id", "pos").collect()] == [("q", "a", 1), ("q", "b", 2)]


def test_common_words_are_not_followed(monkeypatch):
    """A query with a rare word doesn't score every document that has its common ones."""
    n, r = 20_000, np.random.default_rng(1)
    has = {0: np.sort(r.choice(n, 40, False)), 1: np.sort(r.choice(n, 15_000, False)), 2: np.sort(r.choice(n, 18_000, False))}
    idf = [6.0, 0.3, 1e-6]
    term = np.concatenate([np.full(len(x), t) for t, x in has.items()])
    doc = np.concatenate(list(has.values()))
    part = np.array(idf)[term] * r.uniform(1.0, 2.2, len(doc))
    block, looked = bt.Block(np.arange(n), doc, term, part, 3), []
    plain = bt.Block.scores
    monkeypatch.setattr(bt.Block, "scores", lambda self, docs, terms: looked.append(len(docs)) or plain(self, docs, terms))
    ids, s = block.best([0, 1, 2], 10, 0.0)
    assert sum(looked) == 40
    every = np.zeros(n)
    for t in has:
        every[has[t]] += part[term == t]
    every = np.round(every, 9)
    assert set(ids[np.lexsort((ids, -s))[:10]]) == set(np.lexsort((np.arange(n), -every))[:10])


def test_suite_from_an_index_and_from_texts(spark):
    docs = spark.createDataFrame([(*x, f"h{x[0] % 30}", f"c{x[0] % 3}") for x in _documents(60)], f"{COLUMNS}, content_hash string, category string")
    asked = docs.filter("id % 5 = 0").selectExpr("id AS qid", "split(coalesce(description, ''), ' ') AS words", "id", "content_hash", "category")
    a = {r["measure"]: round(r["value"], 9) for r in ev.suite(docs, asked).collect()}
    b = {r["measure"]: round(r["value"], 9) for r in ev.suite(docs, asked, index=sr.build_index(docs, "id", ev.FIELDS)).collect()}
    assert a == b and a["n"] == 12 and a["robust_reordered"] == 1


def test_search_batch_needs_no_index(spark, data, monkeypatch):
    from corpusmill.plans.queries import queries

    monkeypatch.setattr(sr, "build_index", None)
    assert queries()["search_batch"](spark, data).count() > 0


def test_same_words_are_asked_once(spark, monkeypatch):
    """A reordered query has the words of its base, so three of four variants are searched."""
    asked, whole = [], bt.materialise
    monkeypatch.setattr(bt, "materialise", lambda df, label: asked.append(df.count()) or whole(df, label) if label == "sets" else whole(df, label))
    docs = spark.createDataFrame([(1, "pdf", "please read"), (2, "read", "pdf tables"), (3, "", "help with tables")] + [(i, "none", "") for i in range(4, 12)], COLUMNS)
    queries = spark.createDataFrame([(7, ["pdf", "read", "tables"])], "qid int, words array<string>")
    hits = ev.variant_hits(docs, queries, 2)
    assert asked == [3]
    got = {r["variant"]: (r["n"], r["overlap"]) for r in ev.robustness(hits, queries).collect()}
    assert got == {"reordered": (1, 1.0), "filler": (1, 0.5), "shortened": (1, 1.0)}
