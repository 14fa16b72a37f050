"""Which author record a person is.

Candidates (professor_id, pos, candidate): ``candidate`` has id, display_name,
last_known_institutions, x_concepts and counts_by_year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

THRESHOLD, MARGIN, MAX_CANDIDATES = 0.82, 0.05, 5
CANDIDATE = "struct<id:string,display_name:string,last_known_institutions:array<struct<id:string>>,x_concepts:array<struct<display_name:string>>,counts_by_year:array<struct<year:int,works_count:int>>>"
# Words that tie an author's topics to a department.
DEPARTMENT_TOPICS = {
    "physics": ["physics", "quantum", "particle", "condensed matter"],
    "applied_physics": ["applied physics", "photonics", "optics", "materials"],
    "astronomy": ["astronomy", "astrophysics", "cosmology", "planetary"],
    "materials_science": ["materials", "nanotechnology", "metallurgy", "polymers"],
}


def merge_candidates(found: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(professor_id, variant, pos, candidate) of several searches as one list: in
    order, an id once (rows without id all stay), the first ``most``."""
    c = F.col("candidate")
    own = F.coalesce(c["id"], F.concat_ws("/", F.lit(""), F.col("variant").cast("string"), F.col("pos").cast("string")))
    once = Window.partitionBy("professor_id", "own").orderBy("variant", "pos")
    first = found.withColumn("own", own).withColumn("at", F.row_number().over(once)).where("at = 1")
    order = Window.partitionBy("professor_id").orderBy("variant", "pos")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("professor_id", "pos", "candidate")


def institution_score(candidate: Column, institution_id: Column) -> Column:
    ids = F.transform(candidate["last_known_institutions"], lambda i: i["id"])
    return F.when((F.coalesce(institution_id, F.lit("")) != "") & F.array_contains(ids, institution_id), 1.0).otherwise(0.0)


def _any_has(texts: Column, words: list[str]) -> Column:
    return F.exists(texts, lambda t: F.greatest(*[t.contains(w) for w in words]))


def topic_score(candidate: Column, department_type: Column) -> Column:
    topics = F.transform(candidate["x_concepts"], lambda c: F.lower(F.coalesce(c["display_name"], F.lit(""))))
    hit = F.lit(False)
    for kind, words in DEPARTMENT_TOPICS.items():
        hit = hit | ((department_type == kind) & F.coalesce(_any_has(topics, words), F.lit(False)))
    return F.when(hit, 1.0).otherwise(0.0)


def recency_score(candidate: Column) -> Column:
    """By the last year with works; years that are null count as none."""
    years = F.transform(F.filter(candidate["counts_by_year"], lambda y: F.coalesce(y["works_count"], F.lit(0)) != 0), lambda y: y["year"])
    last = F.array_max(years)
    return F.when(last >= 2025, 1.0).when(last >= 2023, 0.7).when(last >= 2021, 0.4).when(last.isNotNull(), 0.1).otherwise(0.0)


def score_candidates(people: DataFrame, candidates: DataFrame) -> DataFrame:
    """people (professor_id, name, department_type, institution_id) with each
    candidate's scores."""
    c = F.col("candidate")
    pairs = candidates.join(people.select("professor_id", "name", "department_type", "institution_id"), "professor_id")
    own = people.select("professor_id", names.name_tokens(F.col("name")).alias("own_tokens"))
    pairs = pairs.join(own, "professor_id").withColumn("their_tokens", names.name_tokens(c["display_name"]))
    pairs = pairs.withColumns({
        "name_score": names.name_similarity(F.col("own_tokens"), F.col("their_tokens")),
        "institution_score": institution_score(c, F.col("institution_id")),
        "topic_score": topic_score(c, F.col("department_type")),
        "recency_score": recency_score(c),
    })
    score = F.lit(0.55) * F.col("name_score") + F.lit(0.25) * F.col("institution_score") + F.lit(0.1) * F.col("topic_score") + F.lit(0.1) * F.col("recency_score")
    return pairs.select("professor_id", "pos", c["id"].alias("candidate_id"), c["display_name"].alias("candidate_display_name"), F.round("name_score", 4).alias("name_score"), "institution_score", "topic_score", "recency_score", F.round(score, 4).alias("score"))


EVIDENCE = ["candidate_display_name", "candidate_id", "institution_score", "name_score", "recency_score", "topic_score"]


def decide(people: DataFrame, scored: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(professor_id, match_status, match_score, author_id, runner_up_score,
    evidence) of each person: unmatched without a candidate at the threshold,
    ambiguous with a runner-up within the margin, else matched."""
    by = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "pos", "score", *EVIDENCE)))
    lists = scored.groupBy("professor_id").agg(by.alias("c"))
    rows = people.select("professor_id").join(lists, "professor_id", "left")
    best, runner = F.get("c", F.lit(0)), F.coalesce(F.get("c", F.lit(1))["score"], F.lit(0.0))
    top = F.coalesce(best["score"], F.lit(0.0))
    status = F.when(F.col("c").isNull() | (top < threshold), "unmatched").when(top - runner <= margin, "ambiguous").otherwise("matched")
    view = lambda x, *more: F.struct(*[x[e].alias(e) for e in EVIDENCE], *[x[m].alias(m) for m in more])
    evidence = F.when(F.col("c").isNull(), F.lit('{"candidates":[]}')).otherwise(F.to_json(F.struct(F.transform("c", lambda x: view(x, "score")).alias("candidates"), F.round(runner, 4).alias("runner_up_score"), view(best).alias("selected"))))
    out = rows.select("professor_id", status.alias("match_status"), top.alias("match_score"), best["candidate_id"].alias("best_id"), F.round(runner, 4).alias("runner_up_score"), evidence.alias("evidence"))
    return out.select("professor_id", "match_status", "match_score", F.when(F.col("match_status") == "matched", F.col("best_id")).alias("author_id"), "runner_up_score", "evidence")


def needs_matching(people: DataFrame, matches: DataFrame) -> DataFrame:
    """People without a match, or unmatched, ambiguous, or matched without an id."""
    rows = people.join(matches.select("professor_id", "match_status", "author_id"), "professor_id", "left")
    status = F.col("match_status")
    return rows.where(status.isNull() | status.isin("unmatched", "ambiguous") | ((status == "matched") & (F.coalesce("author_id", F.lit("")) == "")))


def apply_decision(matches: DataFrame, professor_id: int, status: str, author_id: str | None, reason: str) -> DataFrame:
    """A person's match as set by hand; a manual override scores 1."""
    hit = F.col("professor_id") == professor_id
    evidence = F.to_json(F.struct(F.lit(author_id).alias("author_id"), F.lit(True).alias("manual"), F.lit(reason).alias("reason")), {"ignoreNullFields": "false"})
    score = F.lit(1.0 if status == "manual_override" else None).cast("double")
    return matches.withColumns({"match_status": F.when(hit, status).otherwise(F.col("match_status")), "author_id": F.when(hit, F.lit(author_id).cast("string")).otherwise(F.col("author_id")), "match_score": F.when(hit, score).otherwise(F.col("match_score")), "evidence": F.when(hit, evidence).otherwise(F.col("evidence"))})
