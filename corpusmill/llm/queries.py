"""The pN_ queries and their SQL, over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import capping, dedup, leakage, markup, packing, quantiles, secrets, spans, survivor, walk
from corpusmill.operators.latest import current_rows, latest
from corpusmill.runtime import materialise, small_rows, table

SKILL_TEXTS, SKILL_OBJECTS = ["name", "description", "body"], ["metadata"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.hidden_duplicates(table(spark, sf_dir, "skills"), "id", "last_seen", SKILL_TEXTS, SKILL_OBJECTS)


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.collapse(table(spark, sf_dir, "skills"), "id", "last_seen", SKILL_TEXTS, SKILL_OBJECTS)


def members_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current skills with their cleaned content hash and the stars of their repo."""
    skills = latest(table(spark, sf_dir, "skills"), "id", "last_seen",
                    ["content_hash", "repo", "path", "score", "license", "category", "last_seen"])
    repos = latest(table(spark, sf_dir, "repos"), "full_name", "last_meta_at", ["stars"])
    hashed = skills.withColumn("content_hash", survivor.clean_hash("content_hash"))
    return hashed.join(repos, hashed.repo == repos.full_name, "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    smallest = -F.col("id")
    licensed = F.coalesce(~F.trim("license").isin("", "NOASSERTION"), F.lit(False))
    known = F.coalesce(F.col("category") != "uncategorised", F.lit(False))
    return survivor.survivors(members_by_hash(spark, sf_dir), "content_hash", "id", {
        "keep_id": ([F.col("score"), F.col("stars"), F.col("last_seen"), smallest], None),
        "license_id": ([F.col("last_seen"), smallest], licensed),
        "category_id": ([F.col("score"), smallest], known),
    })


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license, category, path and repo that the members of each content hash agree on most, weighted by stars.

    One row per content hash; a field is null if no member knows it. As in p3_found an empty license or
    NOASSERTION, and the category ``uncategorised``, say nothing and don't vote.
    """
    agreed = survivor.consensus(votes_by_hash(spark, sf_dir), ["content_hash", "field"], "value", vote_weight())
    fields = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in CONSENSUS_FIELDS]
    return agreed.groupBy("content_hash").agg(*fields)


CONSENSUS_FIELDS = ["license", "category", "path", "repo"]


def vote_weight() -> Column:
    """What a member's voice weighs: more with the stars of its repo, nothing more where they are unknown."""
    return F.log1p(F.coalesce("stars", F.lit(0))) + 1


def votes_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_hash, stars, field, value): what each member says of each field that is decided by consensus."""
    members = members_by_hash(spark, sf_dir).filter("content_hash <> ''")
    known = {
        "license": F.when(~F.trim("license").isin("", "NOASSERTION"), F.col("license")),
        "category": F.when(F.col("category") != "uncategorised", F.col("category")),
        "path": F.col("path"),
        "repo": F.col("repo"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in known.items()]))
    return members.select("content_hash", "stars", each.alias("_f")).select("content_hash", "stars", "_f.*")


def p3_consensus_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What consensus takes where at most two values, of different weight, stand against each other: the heavier, whatever their tokens."""
    votes = materialise(votes_by_hash(spark, sf_dir).filter("value IS NOT NULL"), "votes")
    agreed = survivor.consensus(votes, ["content_hash", "field"], "value", vote_weight())
    weights = votes.groupBy("content_hash", "field", "value").agg(F.sum(vote_weight()).alias("w"))
    few = weights.groupBy("content_hash", "field").agg(F.count("*").alias("n"), (F.max("w") - F.min("w")).alias("gap"))
    return agreed.join(few.filter("n = 1 OR n = 2 AND gap > 1e-6"), ["content_hash", "field"], "left_semi")


def capped_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = latest(table(spark, sf_dir, "skills"), "id", "last_seen", ["repo", "first_seen", "category", "score"])
    return skills.withColumn("day", F.to_date("first_seen"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.beyond_cap(capped_skills(spark, sf_dir), "id", ["repo", "day"], F.col("score"), 8).select("id")


def p6_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills beyond 40 per repo, the slots split equally over categories."""
    return capping.beyond_cap(capped_skills(spark, sf_dir), "id", ["repo"], F.col("score"), 40, ["category"], "equal")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "skills"), "id", "body", "last_seen")
    return found.select("id", F.explode("spans").alias("_s")).select("id", "_s.start_pos", "_s.end_pos")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "skills"), "id", "body", "last_seen", redacted=True)
    return found.select("id", "redacted", F.size("spans").alias("n_secrets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found_kinds(table(spark, sf_dir, "skills"), "id", "body", "last_seen")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(current_rows(table(spark, sf_dir, "skills"), "id", "last_seen", ["body"]), "id", "body")


REPO_SCORES = ["stars", "forks", "open_issues", "size_kb"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundredth by rank value: those the walk leaves most mass on at rest, checked by their exact rank value.

    The walk names four times as many as are wanted, so that neighbours it places otherwise are checked as well.
    """
    repos = latest(table(spark, sf_dir, "repos"), "full_name", "last_meta_at", REPO_SCORES)
    ranked = materialise(walk.rank_walk(repos, "full_name", REPO_SCORES, at_least=3, tolerance=1e-4), "ranked")
    k = -(-repos.count() // 100)
    near = walk.first_share(ranked, "full_name", "mass", 4 * k)
    return walk.first_share(near, "full_name", "mid_rank", k).select("full_name")


def p5_rank_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current repos by where the damped walk comes to rest."""
    repos = latest(table(spark, sf_dir, "repos"), "full_name", "last_meta_at", REPO_SCORES)
    return walk.rank_walk(repos, "full_name", REPO_SCORES, tolerance=1e-6).drop("mid_rank")


def stat_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, scope, stat_day, value): what corpus_stats describes, for every scope."""
    both = F.explode(F.array_distinct(F.array(F.lit("all"), F.col("own"))))
    skills = latest(table(spark, sf_dir, "skills"), "id", "last_seen", ["body_len", "source_kind", "first_seen"])
    repos = latest(table(spark, sf_dir, "repos"), "full_name", "last_meta_at", ["stars", "language", "first_seen"])
    one = skills.select(F.lit("body_len").alias("metric"), F.col("source_kind").alias("own"), "first_seen", F.col("body_len").alias("value"))
    two = repos.select(F.lit("stars").alias("metric"), F.col("language").alias("own"), "first_seen", F.col("stars").alias("value"))
    rows = one.unionByName(two).filter("value IS NOT NULL")
    return rows.select("metric", both.alias("scope"), F.to_date("first_seen").alias("stat_day"), "value").filter("scope IS NOT NULL")


STAT_GROUP = ["metric", "scope", "stat_day"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.misstated(table(spark, sf_dir, "corpus_stats"), stat_values(spark, sf_dir), STAT_GROUP,
                               F.col("value"), "stat_id", "quantiles")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 101 even quantiles of every metric, scope and day: pieces that merge."""
    return quantiles.pieces(stat_values(spark, sf_dir), STAT_GROUP, F.col("value"))


def p1_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every metric and scope over all days, merged from the daily pieces."""
    return quantiles.merge_pieces(p1_percentiles(spark, sf_dir), ["metric", "scope"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding 16 neighbouring words of an item with at most two words changed."""
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text",
                         width=16, edits=2)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", 300)


def p10_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amount(table(spark, sf_dir, "documents"), "doc_id", "text", 300)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in tokens, in containers of each capacity in pack_targets."""
    targets = small_rows(table(spark, sf_dir, "pack_targets").select("target_id", "capacity_tokens"), 1000, "pack_targets")
    sizes = materialise(packing.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), "tokens")
    return packing.pack_targets(sizes, "doc_id", "n_tokens", [(t["target_id"], t["capacity_tokens"]) for t in targets])


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: items, containers, the least possible number of them, and the share of space unused."""
    packed = p8_pack(spark, sf_dir)
    per_target = packed.groupBy("target_id").agg(
        F.count("*").alias("pieces"), (F.max("container") + 1).alias("containers"), F.sum("n").alias("tokens"))
    joined = per_target.join(table(spark, sf_dir, "pack_targets"), "target_id")
    return joined.select("target_id", "pieces", "containers", "tokens",
                         F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
                         (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"))


def p1_merged_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per metric and scope the merged percentiles' count, and whether each is within the promised rank error.

    That is a hundredth of the values and one value a piece, on top of a percentile's own place.
    """
    merged = p1_merged(spark, sf_dir)
    values = stat_values(spark, sf_dir)
    days = values.groupBy("metric", "scope").agg(F.countDistinct("stat_day").alias("days"))
    claims = merged.select("metric", "scope", "n", F.posexplode("at").alias("p", "q"))
    counted = values.groupBy("metric", "scope", "value").agg(F.count("*").alias("c"))
    places = counted.join(claims, ["metric", "scope"]).groupBy("metric", "scope", "p").agg(
        F.first("n").alias("n"), F.sum(F.when(F.col("value") < F.col("q"), F.col("c")).otherwise(0)).alias("smaller"),
        F.sum(F.when(F.col("value") <= F.col("q"), F.col("c")).otherwise(0)).alias("upto")).join(days, ["metric", "scope"])
    slack = F.col("n") / 100 + F.col("days") + 1
    right = (F.col("smaller") <= F.col("p") * F.col("n") / 100 + slack) & (F.col("upto") >= F.col("p") * F.col("n") / 100 - slack)
    return places.groupBy("metric", "scope").agg(F.first("n").alias("n"), (F.sum(F.when(right, 0).otherwise(1)) == 0).alias("within"))


def p4_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted records that have another length, changed outside of the secrets, or still hold one: none."""
    skills = table(spark, sf_dir, "skills")
    found = secrets.scan(skills, "id", "body", "last_seen", redacted=True)
    bodies = current_rows(skills, "id", "last_seen", ["body"])
    both = found.join(bodies, "id")
    kept = F.aggregate("spans", F.col("body"), lambda t, x: F.overlay(t, F.repeat(F.lit("*"), (x["end_pos"] - x["start_pos"]).cast("int")), x["start_pos"].cast("int") + 1))
    bare = F.aggregate("spans", F.col("redacted"), lambda t, x: F.overlay(t, F.repeat(F.lit("*"), (x["end_pos"] - x["start_pos"]).cast("int")), x["start_pos"].cast("int") + 1))
    wrong = both.agg(F.count(F.when((F.length("body") != F.length("redacted")) | (kept != bare), 1)).alias("changed"))
    return wrong.crossJoin(secrets.scan(found, "id", "redacted").agg(F.count("*").alias("left")))  # one row each


def p5_walk_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk moves mass and makes none: mass times number of scores adds up to the number of scores."""
    walked = p5_rank_walk(spark, sf_dir)
    return walked.agg(F.count("*").alias("repos"), F.round(F.sum(F.col("mass") * F.col("n_scores"))).cast("bigint").alias("mass"))


def p6_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, left_out): how many skills the cap of 40 leaves out of each repo."""
    return p6_by_category(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("left_out"))


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: documents placed, containers beyond capacity, and documents that fit a container but are split."""
    targets = table(spark, sf_dir, "pack_targets").select("target_id", "capacity_tokens")
    packed = materialise(p8_pack(spark, sf_dir), "packed").join(F.broadcast(targets), "target_id")
    boxes = packed.groupBy("target_id", "container").agg(F.sum("n").alias("used"), F.first("capacity_tokens").alias("room"))
    over = boxes.groupBy("target_id").agg(F.count(F.when(F.col("used") > F.col("room"), 1)).alias("overfull"))
    docs = packed.groupBy("target_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n").alias("size"), F.first("capacity_tokens").alias("room"))
    split = F.count(F.when((F.col("pieces") > 1) & (F.col("size") <= F.col("room")), 1))
    return docs.groupBy("target_id").agg(F.count("*").alias("documents"), split.alias("split_needlessly")).join(over, "target_id")


def p9_near_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): near leaks that hold 16 words of the item verbatim."""
    same = leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", width=16)
    return p9_near(spark, sf_dir).join(same, ["doc_id", "item_id"], "left_semi")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_percentiles": p1_percentiles,
        "p1_merged": p1_merged,
        "p1_merged_bound": p1_merged_bound,
        "p2_found": p2_found,
        "p2_collapsed": p2_collapsed,
        "p3_found": p3_found,
        "p3_consensus": p3_consensus,
        "p3_consensus_two": p3_consensus_two,
        "p4_found": p4_found,
        "p4_redacted": p4_redacted,
        "p4_redaction": p4_redaction,
        "p5_found": p5_found,
        "p5_rank_walk": p5_rank_walk,
        "p5_walk_mass": p5_walk_mass,
        "p6_found": p6_found,
        "p6_by_category": p6_by_category,
        "p6_category_counts": p6_category_counts,
        "p7_found": p7_found,
        "p7_clean": p7_clean,
        "p8_pack": p8_pack,
        "p8_fill": p8_fill,
        "p8_whole": p8_whole,
        "p9_found": p9_found,
        "p9_near": p9_near,
        "p9_near_verbatim": p9_near_verbatim,
        "p10_found": p10_found,
        "p10_amount": p10_amount,
    }


CURRENT_REPOS = "cr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY last_meta_at DESC) AS rn_ FROM repos) WHERE rn_ = 1)"
CURRENT_SKILLS = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC) AS rn_ FROM skills) WHERE rn_ = 1)"


STAT_VALUES = f"""{CURRENT_SKILLS}, {CURRENT_REPOS}, base AS (
  SELECT 'body_len' AS metric, source_kind AS own, CAST(first_seen AT TIME ZONE 'UTC' AS DATE) AS stat_day, body_len AS value FROM cur
  UNION ALL SELECT 'stars', language, CAST(first_seen AT TIME ZONE 'UTC' AS DATE), stars FROM cr), vals AS (
  SELECT metric, 'all' AS scope, stat_day, value FROM base WHERE value IS NOT NULL
  UNION ALL SELECT metric, own, stat_day, value FROM base WHERE value IS NOT NULL AND own IS NOT NULL AND own <> 'all')"""


SHARED = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300),
  w AS (SELECT doc_id, i, md5(substring(text, i + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(0, n - 299)) AS i FROM d)),
  s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
  p AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w SEMI JOIN s USING (h)),
  g AS (SELECT *, sum(CASE WHEN gap <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p),
  r AS (SELECT doc_id, min(i) AS start_pos, max(i) + 300 AS end_pos FROM g GROUP BY doc_id, k)"""


def leaked(width: int) -> str:
    """Documents with ``width`` neighbouring words of an item."""
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    windows = "(SELECT {key}, w, unnest(range(1, len(w) - {width} + 2)) AS s FROM {t} WHERE len(w) >= {width})"
    side = lambda key, t: f"SELECT DISTINCT {key}, array_to_string(w[s:s + {width - 1}], ' ') AS x FROM " + windows.format(key=key, t=t, width=width)
    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, {words} AS w FROM eval_items WHERE text IS NOT NULL),
        dw AS ({side('doc_id', 'd')}), iw AS ({side('item_id', 'i')})
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)"""


def oracle_sql() -> dict[str, str]:
    words = lambda c: f"array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ')"
    same = f"""
    WITH {CURRENT_SKILLS}, keyed AS (
      SELECT id, {words('name')} AS n, {words('description')} AS d, {words('body')} AS b,
        list_sort(list_transform(json_keys(coalesce(metadata, '{{}}')::JSON),
          lambda key: lower(key) || '=' || {words("json_extract_string(metadata::JSON, '$.\"' || key || '\"')")})) AS m
      FROM cur), grouped AS (SELECT id, min(id) OVER (PARTITION BY n, d, b, m) AS first_id FROM keyed)
    """
    return {
        "p1_found": f"""
        WITH {STAT_VALUES}, claims AS (
          SELECT stat_id, metric, scope, stat_day, unnest(range(0, 101)) AS p, unnest(quantiles) AS q FROM corpus_stats), t AS (
          SELECT stat_id, p, q, count(*) AS n, count(*) FILTER (value < q) AS smaller, count(*) FILTER (value <= q) AS upto
          FROM claims JOIN vals USING (metric, scope, stat_day) GROUP BY ALL)
        SELECT DISTINCT stat_id FROM t WHERE (p + 7) * n < 100 * smaller OR (p - 7) * n > 100 * upto""",
        "p1_percentiles": f"""
        WITH {STAT_VALUES}, o AS (SELECT metric, scope, stat_day, count(*) AS n, list_sort(list(value::DOUBLE)) AS l FROM vals GROUP BY ALL)
        SELECT metric, scope, stat_day, n, list_transform(range(0, 101), lambda p: l[greatest(1, (p * n + 99) // 100)]) AS at FROM o""",
        "p1_merged_bound": f"""
        WITH {STAT_VALUES} SELECT metric, scope, count(*) AS n, true AS "within" FROM vals GROUP BY 1, 2""",
        "p3_consensus_two": f"""
        WITH {CURRENT_SKILLS}, {CURRENT_REPOS}, m AS (
          SELECT regexp_replace(lower(trim(cur.content_hash)), '^sha256:', '') AS content_hash, ln(1 + coalesce(cr.stars, 0)) + 1 AS w,
            CASE WHEN trim(cur.license) NOT IN ('', 'NOASSERTION') THEN cur.license END AS license,
            CASE WHEN cur.category <> 'uncategorised' THEN cur.category END AS category, cur.path, cur.repo
          FROM cur LEFT JOIN cr ON cur.repo = cr.full_name), v AS (
          SELECT content_hash, field, value, sum(w) AS w FROM m UNPIVOT (value FOR field IN (license, category, path, repo))
          WHERE content_hash <> '' GROUP BY ALL)
        SELECT content_hash, field, arg_max(value, w) AS value FROM v GROUP BY 1, 2
        HAVING count(*) = 1 OR count(*) = 2 AND max(w) - min(w) > 1e-6""",
        "p4_redaction": "SELECT 0::BIGINT AS changed, 0::BIGINT AS \"left\"",
        "p5_walk_mass": f"""
        WITH {CURRENT_REPOS}, s AS (SELECT (stars IS NOT NULL)::INT + (forks IS NOT NULL)::INT + (open_issues IS NOT NULL)::INT + (size_kb IS NOT NULL)::INT AS k FROM cr)
        SELECT count(*) AS repos, sum(k)::BIGINT AS mass FROM s WHERE k > 0""",
        "p6_category_counts": f"""
        WITH {CURRENT_SKILLS} SELECT repo, count(*) - 40 AS left_out FROM cur GROUP BY repo HAVING count(*) > 40""",
        "p8_whole": """
        SELECT target_id, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS split_needlessly
        FROM pack_targets""",
        "p2_found": same + "SELECT first_id, id AS copy_id FROM grouped WHERE id <> first_id",
        "p2_collapsed": same + "SELECT first_id, count(*) AS copies FROM grouped GROUP BY first_id",
        "p3_found": f"""
        WITH {CURRENT_SKILLS}, {CURRENT_REPOS}, m AS (
          SELECT regexp_replace(lower(trim(cur.content_hash)), '^sha256:', '') AS content_hash, cur.id, cur.score, cur.license,
            cur.category, cur.last_seen, cr.stars FROM cur LEFT JOIN cr ON cur.repo = cr.full_name), g AS (
          SELECT content_hash FROM m WHERE content_hash <> '' GROUP BY 1 HAVING count(DISTINCT id) > 1), k AS (
          SELECT content_hash, id, row_number() OVER (PARTITION BY content_hash ORDER BY score DESC NULLS LAST, stars DESC NULLS LAST, last_seen DESC, id) AS r FROM m), l AS (
          SELECT content_hash, id, row_number() OVER (PARTITION BY content_hash ORDER BY last_seen DESC, id) AS r FROM m
          WHERE trim(license) NOT IN ('', 'NOASSERTION')), c AS (
          SELECT content_hash, id, row_number() OVER (PARTITION BY content_hash ORDER BY score DESC NULLS LAST, id) AS r FROM m
          WHERE category <> 'uncategorised')
        SELECT g.content_hash, k.id AS keep_id, coalesce(l.id, 0) AS license_id, coalesce(c.id, 0) AS category_id
        FROM g JOIN k ON k.content_hash = g.content_hash AND k.r = 1 LEFT JOIN l ON l.content_hash = g.content_hash AND l.r = 1
        LEFT JOIN c ON c.content_hash = g.content_hash AND c.r = 1""",
        "p5_found": f"""
        WITH {CURRENT_REPOS}, long AS (
          SELECT full_name, c, v FROM (SELECT full_name, stars, forks, open_issues, size_kb FROM cr)
          UNPIVOT (v FOR c IN (stars, forks, open_issues, size_kb))), pos AS (
          SELECT full_name, ((rank() OVER (PARTITION BY c ORDER BY v) - 1) + (count(*) OVER (PARTITION BY c ORDER BY v)))
            / (count(*) OVER (PARTITION BY c))::DOUBLE / 2 AS p FROM long)
        SELECT full_name FROM (SELECT full_name, row_number() OVER (ORDER BY round(avg(p), 12) DESC, full_name) AS r FROM pos
          GROUP BY full_name HAVING count(*) >= 3) WHERE r <= (SELECT ceil(count(*) / 100.0) FROM cr)""",
        "p9_found": leaked(12),
        "p9_near_verbatim": leaked(16),
        "p10_found": SHARED + " SELECT doc_id, start_pos, end_pos FROM r",
        "p10_amount": SHARED + """, a AS (SELECT doc_id, sum(end_pos - start_pos)::BIGINT AS c FROM r GROUP BY 1)
          SELECT doc_id, coalesce(c, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text)::DOUBLE ELSE 0.0 END AS share
          FROM documents LEFT JOIN a USING (doc_id)""",
        "p6_found": f"""
        WITH {CURRENT_SKILLS} SELECT id FROM (SELECT id, row_number() OVER (
          PARTITION BY repo, CAST(first_seen AT TIME ZONE 'UTC' AS DATE) ORDER BY score DESC NULLS LAST, id) AS r FROM cur) WHERE r > 8""",
    }
