"""Does a person's list of works look like theirs?

One plan for all people: cohort, works of the cohort, terms of all rows that
belong to a person (the canonical row and its duplicates), ratios and rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .works import topic_names

# Words that tie a work to a department.
AUDIT_WORDS = {
    "physics": ["physics", "quantum", "particle", "condensed matter", "superconduct", "photon", "optics", "spin", "semiconductor", "materials"],
    "applied_physics": ["applied physics", "photon", "laser", "optics", "nanophotonics", "device", "materials", "quantum", "semiconductor", "photonics"],
    "astronomy": ["astronomy", "astrophysics", "cosmology", "galaxy", "stellar", "planet", "exoplanet", "supernova", "black hole", "quasar", "gravitational", "solar", "neutron star"],
    "materials_science": ["materials", "alloy", "polymer", "battery", "catalyst", "semiconductor", "surface", "nanoparticle", "electrochem", "metall"],
}
PROFILE_TERMS, SHOWN_TERMS, SHOWN_TITLES = 18, 6, 5


def work_blob(title: Column, abstract: Column, source_name: Column, topics_json: Column) -> Column:
    some = lambda c: F.when(c != "", F.lower(c))
    return F.concat_ws(" ", some(title), some(abstract), some(source_name), some(topic_names(topics_json)))


def department_hit(departments: Column, blob: Column) -> Column:
    """Whether a blob has a word of any of the departments."""
    hit = F.lit(False)
    for kind, words in AUDIT_WORDS.items():
        hit = hit | (F.array_contains(departments, kind) & F.greatest(*[blob.contains(w) for w in words]))
    return hit


def affiliated(cohort: DataFrame, people: DataFrame) -> DataFrame:
    """Rows of each cohort member: its own and those marked its duplicates.  The
    cohort is canonical, so one key says it: whom a row stands for."""
    rows = people.withColumn("owner", F.coalesce("duplicate_of", "professor_id"))
    return rows.join(cohort.select(F.col("professor_id").alias("owner")), "owner", "left_semi")


def profile_terms(rows: DataFrame) -> DataFrame:
    """(owner, terms): the commonest informative terms of title, snippet and profile
    text over an owner's rows; ties go to the first seen, rows in order of id."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    seed = rows.select("owner", "professor_id", text.informative_terms(F.concat_ws(" ", some("title"), some("source_snippet"), some("profile_text"))).alias("words"))
    at = seed.select("owner", "professor_id", F.posexplode("words").alias("pos", "term"))
    counted = at.groupBy("owner", "term").agg(F.count("*").alias("n"), F.min(F.struct("professor_id", "pos")).alias("first"))
    order = Window.partitionBy("owner").orderBy(F.desc("n"), "first")
    top = counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= PROFILE_TERMS)
    return top.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("t")).select("owner", F.transform("t", lambda t: t["term"]).alias("terms"))


def ratios(cohort: DataFrame, people: DataFrame, works: DataFrame, links: DataFrame, min_works: int = 15) -> DataFrame:
    """Per cohort member with enough works: counts, shares, alignment, terms."""
    rows = affiliated(cohort, people)
    departments = rows.groupBy("owner").agg(F.collect_set("department_type").alias("departments"))
    owners = departments.join(profile_terms(rows), "owner", "left")
    theirs = links.select(F.col("professor_id").alias("owner"), "work_id").distinct().join(owners, "owner").join(works, "work_id")
    blob = work_blob(F.col("title"), F.col("abstract"), F.col("source_name"), F.col("topics_json"))
    theirs = theirs.withColumn("blob", blob)
    some = F.coalesce("terms", F.array().cast("array<string>"))
    theirs = theirs.withColumn("hit", department_hit(F.col("departments"), F.col("blob"))).withColumn("overlap", F.array_intersect(some, text.informative_terms(F.col("blob"))))
    is_arxiv = F.lower(F.coalesce("source_name", F.lit(""))).startswith("arxiv")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    has_abstract = F.regexp_replace(F.coalesce("abstract", F.lit("")), r"(?U)\s+", "") != ""
    sums = theirs.groupBy("owner").agg(
        F.count("*").alias("total_works"),
        share(F.col("hit")).alias("keyword_share"),
        share(has_abstract).alias("abstract_share"),
        share(is_arxiv).alias("arxiv_share"),
        F.count_distinct(F.when(F.col("source_name") != "", F.col("source_name"))).alias("distinct_source_count"),
        share(F.size("overlap") > 0).alias("work_share"),
        F.first("terms").alias("terms"),
    )
    sums = sums.where(F.col("total_works") >= min_works)
    # the first few by id, taken before titles are gathered
    first = Window.partitionBy("owner").orderBy("work_id")
    off = theirs.where(~F.col("hit") & (F.col("title") != "")).select("owner", "work_id", "title").withColumn("at", F.row_number().over(first)).where(F.col("at") <= SHOWN_TITLES)
    off = off.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("work_id", "title"))).alias("off"))
    sums = sums.join(off, "owner", "left")
    # terms are counted before the shuffle, and each task keeps an owner's first few only,
    # so an owner of very many works is no heavier than others
    order = Window.partitionBy("owner").orderBy(F.desc("n"), "term")
    counted = theirs.select("owner", F.explode("overlap").alias("term")).groupBy("owner", "term").agg(F.count("*").alias("n"))
    top = counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SHOWN_TERMS)
    top = top.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("shown"))
    seen = counted.groupBy("owner").agg(F.count("*").alias("covered")).join(top, "owner")
    out = sums.join(seen, "owner", "left")
    coverage = F.coalesce("covered", F.lit(0)) / F.size("terms")
    return out.select(
        F.col("owner").alias("professor_id"),
        "total_works",
        "keyword_share",
        F.when(F.size("terms") > 0, F.round(F.greatest(coverage, F.col("work_share")), 4)).alias("profile_alignment_ratio"),
        "abstract_share",
        "arxiv_share",
        "distinct_source_count",
        F.transform(F.coalesce("shown", F.array().cast("array<struct<at:int,term:string>>")), lambda t: t["term"]).alias("profile_terms"),
        F.transform(F.coalesce("off", F.array().cast("array<struct<work_id:bigint,title:string>>")), lambda t: t["title"]).alias("sample_off_topic_titles"),
    )


def suspicion(rows: DataFrame) -> DataFrame:
    """``rows`` with suspicious_score and reasons."""
    aligned, keyword, total = F.col("profile_alignment_ratio"), F.col("keyword_share"), F.col("total_works")
    base = F.coalesce(aligned, keyword)
    many = total >= 20
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("low_profile_alignment", yes(many & (aligned < 0.22)), F.lit(0.45)),
        ("low_department_alignment", yes(many & (keyword < 0.55) & (aligned.isNull() | (aligned < 0.35))), F.when(aligned.isNotNull(), 0.25).otherwise(0.35)),
        ("low_abstract_coverage", yes(many & (F.col("abstract_share") < 0.55)), F.lit(0.15)),
        ("high_venue_diversity", yes((F.col("distinct_source_count") >= 35) & (base < 0.7)), F.lit(0.15)),
        ("mostly_arxiv", yes(many & (F.col("arxiv_share") > 0.85)), F.lit(0.05)),
    ]
    score = F.lit(1.0) - base
    for _, hit, more in rules:
        score = score + F.when(hit, more).otherwise(0.0)
    return rows.withColumn("suspicious_score", F.round(score, 4)).withColumn("reasons", F.array_compact(F.array(*[F.when(hit, name) for name, hit, _ in rules])))


def audit_publications(people: DataFrame, universities: DataFrame, matches: DataFrame, works: DataFrame, links: DataFrame, min_works: int = 15, limit: int | None = 25) -> DataFrame:
    """People whose works give a reason for doubt, worst first."""
    cohort = people.where((F.col("verification_status") == "verified") & F.col("duplicate_of").isNull()).join(matches.where("match_status = 'matched'"), "professor_id", "left_semi")
    found = suspicion(ratios(cohort, people, works, links, min_works)).where(F.size("reasons") > 0)
    named = found.join(people.select("professor_id", F.col("name").alias("professor_name"), "university_id", "department_type"), "professor_id").join(universities.select("university_id", F.col("name").alias("university_name")), "university_id")
    shares = {f"{k}_ratio": F.round(f"{v}_share", 4) for k, v in (("keyword_hit", "keyword"), ("abstract_coverage", "abstract"), ("arxiv", "arxiv"))}
    out = named.withColumns(shares).select("professor_id", "professor_name", "university_name", "department_type", "total_works", "keyword_hit_ratio", "profile_alignment_ratio", "abstract_coverage_ratio", "arxiv_ratio", "distinct_source_count", "suspicious_score", "reasons", "profile_terms", "sample_off_topic_titles")
    order = [F.desc("suspicious_score"), F.desc("total_works"), F.asc("professor_id")]
    return out.orderBy(*order) if limit is None else out.orderBy(*order).limit(limit)
