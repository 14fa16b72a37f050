"""Works from author records: abstracts, authorship, topics, what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORK = "id string, title string, abstract_inverted_index map<string,array<int>>, publication_year int, publication_date string, doi string, cited_by_count int, primary_location struct<source:struct<display_name:string>>, type string, concepts array<struct<display_name:string,name:string>>, topics array<struct<display_name:string,name:string>>, authorships array<struct<author:struct<id:string>,author_position:string,is_corresponding:boolean>>"


def reconstruct_abstract(index: Column) -> Column:
    """Text of a word -> positions map, words in order of position; a position that
    two words claim goes to the later entry.  Null gives null."""
    entries = F.map_entries(index)
    claims = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), (-i).alias("late"), e["key"].alias("word")))))
    ordered = F.array_sort(claims)
    before = F.concat(F.array(F.lit(None)), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))))
    # of equal positions the first in order is the latest entry
    words = F.zip_with(ordered, before, lambda c, b: F.when(b.isNull() | (b["p"] != c["p"]), c["word"]))
    text = F.array_join(F.array_compact(words), " ")
    return F.when(text != "", text)


def authorship(authorships: Column, author_id: Column) -> Column:
    """struct(position, is_corresponding) of the author's first entry; "unknown" and
    null without one."""
    own = F.try_element_at(F.filter(authorships, lambda a: a["author"]["id"] == author_id), F.lit(1))
    position = F.coalesce(F.when(own["author_position"] != "", own["author_position"]), F.lit("unknown"))
    return F.struct(position.alias("position"), own["is_corresponding"].alias("is_corresponding"))


def topics(concepts: Column, topics: Column) -> Column:
    """Concepts if there are any, else topics, else an empty list."""
    empty = F.array().cast("array<struct<display_name:string,name:string>>")
    return F.when(F.size(F.coalesce(concepts, empty)) > 0, concepts).otherwise(F.coalesce(topics, empty))


def topic_names(topics_json: Column) -> Column:
    """Names in a JSON list of topics; anything else gives ''."""
    parsed = F.from_json(topics_json, "array<struct<display_name:string,name:string>>")
    name = lambda t: F.coalesce(F.when(t["display_name"] != "", t["display_name"]), t["name"])
    return F.coalesce(F.array_join(F.filter(F.transform(parsed, name), lambda n: n.isNotNull()), " "), F.lit(""))


def parse_works(payloads: DataFrame) -> DataFrame:
    """Work rows from payload rows; of several payloads of an id the last by
    ``seq`` counts."""
    last = payloads.groupBy("id").agg(F.max_by(F.struct(*[c for c in payloads.columns if c not in ("id", "seq")]), "seq").alias("w")).select("id", "w.*")
    return last.select(
        F.col("id").alias("external_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        reconstruct_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        "publication_year",
        "publication_date",
        "doi",
        "cited_by_count",
        F.col("primary_location.source.display_name").alias("source_name"),
        "type",
        F.to_json(topics(F.col("concepts"), F.col("topics"))).alias("topics_json"),
    )


def author_links(payloads: DataFrame) -> DataFrame:
    """(professor_id, external_id, authorship_position, is_corresponding) from
    payload rows that also have professor_id and author_id."""
    a = authorship(F.col("authorships"), F.col("author_id"))
    rows = payloads.select("professor_id", F.col("id").alias("external_id"), "seq", a.alias("a"))
    last = rows.groupBy("professor_id", "external_id").agg(F.max_by("a", "seq").alias("a"))
    return last.select("professor_id", "external_id", F.col("a.position").alias("authorship_position"), F.col("a.is_corresponding").alias("is_corresponding"))


def needs_works(people: DataFrame, matches: DataFrame, links: DataFrame) -> DataFrame:
    """Verified canonical people with an author and without any work."""
    known = matches.where(F.col("match_status").isin("matched", "manual_override")).select("professor_id", "author_id", "match_status")
    ready = people.where((F.col("verification_status") == "verified") & F.col("duplicate_of").isNull())
    return ready.join(known, "professor_id").join(links.select("professor_id").distinct(), "professor_id", "left_anti")


def needs_embedding(works: DataFrame, stored: DataFrame, backend: str, dimension: int) -> DataFrame:
    """Works without a vector, or with one of another backend or dimension."""
    have = stored.select("work_id", F.col("backend").alias("b"), F.col("dimension").alias("d"))
    rows = works.join(have, "work_id", "left")
    return rows.where(F.col("b").isNull() | (F.col("b") != backend) | (F.col("d") != dimension)).drop("b", "d")


def resume(rows: DataFrame, key: str, last: int | None, limit: int | None = None) -> DataFrame:
    """Rows after a checkpoint, in order, the first ``limit`` of them."""
    if limit is not None and limit < 0:
        raise ValueError("a limit is zero or more")
    out = rows if last is None else rows.where(F.col(key) > last)
    return out.orderBy(key) if limit is None else out.orderBy(key).limit(limit)
