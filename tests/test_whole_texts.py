"""Nothing that stands late in a text is left out."""

import io
import tarfile

from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vx
from corpusmill.operators.search import FIELD_WEIGHTS
from corpusmill.plans import release as rl
from corpusmill.sources import files as sf


def test_late_words_are_embedded(spark):
    long = "word " * 400
    df = spark.createDataFrame([(1, long), (2, long + "zebra")], "id int, body string")
    text = tx.embed_text(F.lit("n"), F.lit("d"), F.lit("o/r"), F.col("body"))
    got = {r["id"]: list(r["v"]) for r in df.select("id", vx.embedder("hashing", dim=64)(text).alias("v")).collect()}
    assert got[1] != got[2]
    cut = df.select(tx.embed_text(F.lit("n"), F.lit("d"), F.lit("o/r"), F.col("body"), 1500).alias("t")).distinct()
    assert cut.count() == 1


def test_release_index_knows_words_beyond_the_stored_part(spark, tmp_path):
    skills = spark.createDataFrame([(1, "o/r", "n", "d", "word " * 500 + "zebra", 1, "none", 5.0)],
                                   "id int, repo string, name string, description string, body string, valid int, risk_level string, score double")
    repos = spark.createDataFrame([("o/r",)], "full_name string")
    for c in FIELD_WEIGHTS:
        skills = skills if c in skills.columns else skills.withColumn(c, F.lit(""))
    rl.build(skills, repos, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/index/postings").filter("term = 'zebra'").count() == 1
    assert len(spark.read.parquet(f"{tmp_path}/skills").first()["body"]) == 2000


def test_archives_are_read_whole():
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for i in range(5003):
            body = b"x" * (600 * 1024 if i == 0 else 1)
            member = tarfile.TarInfo(f"top/d{i}/SKILL.md")
            member.size = len(body)
            tar.addfile(member, io.BytesIO(body))
    got = list(sf.archive_members(data.getvalue()))
    assert len(got) == 5003 and len(got[0][1]) == 600 * 1024
    assert len(list(sf.archive_members(data.getvalue(), most=7, largest=1024))) == 7
