"""Views of the store: details, comparison, review, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import contains_name
from . import nameindex


def recent_works(links: DataFrame, works: DataFrame, n: int | None = 8, by: str = "id") -> DataFrame:
    """Works of each person, newest first (no year last), the first n.  ``by``: equal
    years go by greater "id", or by more "citations" (unknown last) and then id."""
    later = [F.desc_nulls_last("publication_year")] + ([F.desc_nulls_last("cited_by_count")] if by == "citations" else [])
    order = Window.partitionBy("professor_id").orderBy(*later, F.desc("work_id"))
    out = links.select("professor_id", "work_id").distinct().join(works, "work_id").withColumn("place", F.row_number().over(order))
    return out if n is None else out.where(F.col("place") <= n)


def parse_ids(text: str | None, most: int = 4) -> list[int]:
    """Whole numbers above zero of a comma list, once each, in order, the first few."""
    found = [int(p) for p in (part.strip() for part in (text or "").split(",")) if p.isdigit()]
    return list(dict.fromkeys(i for i in found if i > 0))[:most]


def compare(people: DataFrame, universities: DataFrame, matches: DataFrame, ids: list[int]) -> DataFrame:
    """The people of a list, in its order, with university and match."""
    place = F.array_position(F.array(*[F.lit(i).cast("bigint") for i in ids]) if ids else F.array().cast("array<bigint>"), F.col("professor_id").cast("bigint"))
    rows = people.where(F.col("professor_id").isin(ids)).withColumn("place", place.cast("int"))
    return details(rows, universities, matches).orderBy("place")


def details(people: DataFrame, universities: DataFrame, matches: DataFrame) -> DataFrame:
    """People with university name and, where there is one, match."""
    m = matches.select("professor_id", "match_status", "match_score", "author_id")
    return people.join(universities.select("university_id", F.col("name").alias("university_name")), "university_id").join(m, "professor_id", "left")


def duplicates_of(people: DataFrame, universities: DataFrame) -> DataFrame:
    """Each duplicate with the name and university of the row it stands for."""
    who = people.select(F.col("professor_id").alias("duplicate_of"), F.col("name").alias("canonical_name"), "university_id").join(universities.select("university_id", F.col("name").alias("canonical_university")), "university_id").drop("university_id")
    return people.where(F.col("duplicate_of").isNotNull()).select("professor_id", "name", "duplicate_of", "duplicate_reason").join(who, "duplicate_of")


def by_name(people: DataFrame, part: str, index: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The people whose name contains a text, by ``nameindex`` if there is an index."""
    if index is not None:
        return nameindex.by_name(people, index, part)
    return people.where(contains_name(F.col("name"), part)).orderBy("professor_id")


def resolve_one(people: DataFrame, professor_id: int | None = None, name: str | None = None, index: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> int:
    """The one person meant by id or part of a name; refuses none and several."""
    rows = (people.where(F.col("professor_id") == professor_id) if professor_id is not None else by_name(people, name or "", index)).select("professor_id").take(2)
    if len(rows) != 1:
        raise LookupError("no such person" if not rows else "several people match; give an id")
    return rows[0][0]


def review_queue(people: DataFrame, universities: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches to look at: ambiguous ones, then unmatched, by name."""
    rows = matches.where(F.col("match_status").isin("ambiguous", "unmatched")).join(people, "professor_id").join(universities.select("university_id", F.col("name").alias("university_name")), "university_id")
    return rows.select("professor_id", "name", "university_name", "match_status", "match_score").orderBy("match_status", "name", "professor_id")


def department_types(people: DataFrame) -> DataFrame:
    return people.where(F.col("department_type").isNotNull()).select("department_type").distinct().orderBy("department_type")


def status_counts(people: DataFrame, matches: DataFrame, works: DataFrame, candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, count) of what the store holds, one aggregation a table."""
    canonical = (F.col("verification_status") == "verified") & F.col("duplicate_of").isNull()
    p = people.agg(F.count_if(canonical).alias("verified_professors"), F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicate_professors"))
    m = matches.agg(*[F.count_if(F.col("match_status").isin(s)).alias(n) for n, s in (("matched_authors", ["matched", "manual_override"]), ("ambiguous_matches", ["ambiguous"]), ("unmatched_authors", ["unmatched"]))])
    rest = [t.agg(F.count("*").alias(n)) for t, n in ((works, "works"), (candidates, "candidates"), (vectors, "embedded_works"))]
    out = None
    for t in (p, m, *rest):
        long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("count")) for c in t.columns])).alias("r")).select("r.*")
        out = long if out is None else out.unionByName(long)
    return out
