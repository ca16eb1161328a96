"""A dominant content or repo must not push other documents off a page."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import fusion as fu
from corpusmill.plans import queries as core
from corpusmill.plans import retrieve as rt

DETAIL = "id int, repo string, path string, name string, description string, body string, source_kind string, license string, score double, content_hash string, risk_level string, valid int, first_seen timestamp"
REPO = "full_name string, license string, stars int, language string, pushed_at timestamp, owner_type string, is_fork boolean, archived boolean"


def corpus(spark, rows):
    """(id, repo, name, score, content_hash) rows as skills and repos."""
    full = [(i, repo, "p", name, "", "", "skill", "MIT", score, h, "none", 1, None) for i, repo, name, score, h in rows]
    repos = [(r, "MIT", 5, "Go", None, "User", False, False) for r in sorted({x[1] for x in rows})]
    return spark.createDataFrame(full, DETAIL), spark.createDataFrame(repos, REPO)


def page(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_copies_of_one_content_leave_room(spark):
    rows = [(i, f"hot/r{i}", "storyboard storyboard storyboard", 50.0, "same") for i in range(150)]
    rows += [(1000 + i, f"o/r{i}", "storyboard and others", 40.0 - i, f"h{i}") for i in range(30)]
    rows += [(2000 + i, f"x/r{i}", "nothing", 1.0, f"n{i}") for i in range(400)]
    skills, repos = corpus(spark, rows)
    got = rt.search(skills, repos, "storyboard", now=F.lit("2024-03-01").cast("timestamp")).orderBy("pos").collect()
    assert len(got) == 20 and {r["id"]: r["duplicates"] for r in got}[0] == 149
    cut = rt.search(skills, repos, "storyboard", now=F.lit("2024-03-01").cast("timestamp"), cut_first=True)
    assert cut.count() == 1


def test_a_dominant_repo_leaves_room_in_search(spark):
    rows = [(i, "hot/one", "storyboard storyboard storyboard", 50.0, f"s{i}") for i in range(150)]
    rows += [(1000 + i, f"o/r{i}", "storyboard and others", 40.0 - i, f"h{i}") for i in range(30)]
    rows += [(2000 + i, f"x/r{i}", "nothing", 1.0, f"n{i}") for i in range(400)]
    skills, repos = corpus(spark, rows)
    got = rt.search(skills, repos, "storyboard", now=F.lit("2024-03-01").cast("timestamp"))
    assert got.filter("repo = 'hot/one'").count() == 3 and got.count() == 20


def test_pages_of_browse_fit_together(spark):
    rows = [(i, "hot/one", "n", 90.0, f"s{i}") for i in range(200)]
    rows += [(1000 + i, f"o/r{i % 40}", "n", 40.0 - i / 10, f"h{i}") for i in range(70)]
    skills, repos = corpus(spark, rows)
    first = [0, 1, 2]
    taken: dict[str, int] = {}
    late = []
    for i, repo, *_ in rows[200:]:
        taken[repo] = taken.get(repo, 0) + 1
        (first if taken[repo] <= 3 else late).append(i)
    want = first + list(range(3, 200)) + late
    got = []
    for offset in (0, 20, 40, 60, 80):
        got += page(rt.browse(skills, repos, limit=20, offset=offset, now=F.lit("2024-03-01").cast("timestamp")))
    assert got == want[:100]
    assert page(rt.browse(skills, repos, limit=1500, now=F.lit("2024-03-01").cast("timestamp"))) == want


def test_lists_are_ranked_without_a_window_over_all(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"r{i}", float(-i)) for i in range(900)], "id int, repo string, s double")
    order = [F.col("s").desc(), F.col("id")]
    hot, got = 0, fu.diversify(df, "repo", order)
    first, late = [], []
    for i in range(900):
        hot += bool(i % 3)
        (late if i % 3 and hot > 3 else first).append(i)
    assert page(got) == first + late
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repo" not in plan


@pytest.mark.parametrize("name", ["list_diversify_all", "list_fusion_all", "list_severity_all"])
def test_every_skill_has_a_place(spark, data, name):
    assert core.queries()[name](spark, data).count() == core.skills(spark, data, "repo").count()
