import pyarrow as pa
import numpy as np
import re
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from corpusmill.llm import dedup
from corpusmill.llm import kernel as k

COLS = "id int, name string, body string, meta string, h1 string, _n int, first_id string"


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.one_of(hs.none(), hs.text(alphabet="aB1é_ .\n\u00a0İß²", max_size=12)), max_size=6))
def test_words_are_those_of_the_definition(texts):
    hashed, bounds = k.words(pa.array(texts, pa.string()))
    want = [[w.lower() for w in re.findall(r"[^\W_]+", t or "")] for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    seen = {}
    for w, h in zip([w for ws in want for w in ws], hashed.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_groups_nulls_and_clashing_columns(spark):
    rows = [
        (5, "A b", "Text, with marks", '{"K": "v w", "x": null}'), (3, "a-B", "text with MARKS!", '{"x": "", "k": "V, w"}'),
        (9, "ab", "text with marks", '{"k": "v w", "x": ""}'), (1, None, None, None), (2, "", " ", "{}"), (4, "", "", '{"a": "b"}'),
        (7, "z", "y", "not json"), (8, "Z", "y.", "not, JSON"), (None, "", "", None), (3, "a-B", "text with MARKS!", '{"x": "", "k": "V, w"}'),
    ]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], COLS)
    got = sorted(tuple(r) for r in dedup.hidden_duplicates(df, "id", None, ["name", "body"], ["meta"]).collect())
    assert got == [(1, 2), (3, 5), (7, 8)]
    assert {r[0]: r[1] for r in dedup.collapse(df, "id", None, ["name", "body"], ["meta"]).collect()} == {1: 2, 3: 2, 4: 1, 7: 2, 9: 1}
    assert dedup.hidden_duplicates(df.limit(0), "id", None, ["name", "body"], ["meta"]).count() == 0


def test_latest_state_counts(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "A.", 1)], "id int, t string, at int").withColumn("at", F.timestamp_seconds("at"))
    assert dedup.hidden_duplicates(df, "id", "at", ["t"]).count() == 0


def test_colliding_records_are_grouped_anew(spark, monkeypatch):
    real = dedup.fingerprints
    flat = lambda df, *args: real(df, *args).withColumn("h1", F.lit(0).cast("bigint")).withColumn("h2", F.lit(0).cast("bigint"))
    monkeypatch.setattr(dedup, "fingerprints", flat)
    rows = [(i, f"text {i % 4}" + "!" * (i % 3)) for i in range(20)] + [(99, "alone")]
    df = spark.createDataFrame(rows, "id int, t string")
    want = sorted((i % 4, i) for i in range(4, 20))
    for few, hot in ((100, 20_000), (0, 20_000), (0, 2)):
        monkeypatch.setattr(dedup, "HOT_GROUP", hot)
        assert sorted(tuple(r) for r in dedup.hidden_duplicates(df, "id", None, ["t"], few=few).collect()) == want


def test_long_text(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, long), (2, long.upper() + "!"), (3, long + "x")], "id int, t string")
    assert [tuple(r) for r in dedup.hidden_duplicates(df, "id", None, ["t"]).collect()] == [(1, 2)]


def test_two_pointers():
    assert dedup.same_words("A  b", "a,B") and not dedup.same_words("a b", "ab") and dedup.same_words(None, "...")
    assert dedup.same_object('{"a": 1, "B": "x"}', '{"b": "X!", "A": 1}') and not dedup.same_object('{"a": 1}', "{}")
