"""Which rows are the same person.

Both rules pick a canonical row of a group by one aggregation (no window sort,
combined before the shuffle) and mark the others by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..scratch import cut

SAME_NAME, SAME_AUTHOR = "same_university_name", "same_author"


def _length(column: str):
    return F.char_length(F.coalesce(column, F.lit("")))


def _has(column: str):
    return (F.coalesce(column, F.lit("")) != "").cast("int")


def same_name(people: DataFrame) -> DataFrame:
    """``people`` with duplicate_of and duplicate_reason set anew for verified rows
    that share university and normalised name.  Canonical: a profile link, the
    longer name, the longer title, the smaller id."""
    stale = F.col("duplicate_reason").eqNullSafe(SAME_NAME) & (F.col("verification_status") == "verified")
    rows = people.withColumn("duplicate_of", F.when(~stale, F.col("duplicate_of"))).withColumn("duplicate_reason", F.when(~stale, F.col("duplicate_reason")))
    order = F.struct(_has("profile_url"), _length("name"), _length("title"), -F.col("professor_id"))
    group = ["university_id", "normalized_name"]
    best = rows.where("verification_status = 'verified'").groupBy(group).agg(F.max_by("professor_id", order).alias("canonical"), F.count("*").alias("n")).where("n > 1")
    best = best.select(*group, "canonical", F.lit("verified").alias("verification_status"))
    joined = rows.join(best, [*group, "verification_status"], "left")
    other = F.col("canonical").isNotNull() & (F.col("canonical") != F.col("professor_id"))
    first = F.col("canonical") == F.col("professor_id")
    return joined.withColumn("duplicate_reason", F.when(other, SAME_NAME).otherwise(F.col("duplicate_reason"))).withColumn("duplicate_of", F.when(other, F.col("canonical")).when(~F.coalesce(first, F.lit(False)), F.col("duplicate_of"))).select(people.columns)


def same_author(people: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People and matches after marking canonical rows of one university that are
    matched with the same author.  Canonical: the greater match score, then as for
    names."""
    open_rows = matches.where((F.col("match_status") == "matched") & F.col("author_id").isNotNull()).join(people.where(F.col("duplicate_of").isNull()), "professor_id")
    order = F.struct(F.coalesce("match_score", F.lit(0.0)), _has("profile_url"), _length("name"), _length("title"), -F.col("professor_id"))
    group = ["university_id", "author_id"]
    best = open_rows.groupBy(group).agg(F.max_by("professor_id", order).alias("canonical"), F.count("*").alias("n")).where("n > 1")
    lost = open_rows.join(best, group).where("professor_id != canonical").select("professor_id", "canonical")
    people = people.join(lost, "professor_id", "left").withColumn("duplicate_of", F.coalesce("canonical", "duplicate_of")).withColumn("duplicate_reason", F.when(F.col("canonical").isNotNull(), SAME_AUTHOR).otherwise(F.col("duplicate_reason"))).drop("canonical")
    evidence = F.to_json(F.struct(F.col("author_id"), F.col("canonical").alias("duplicate_of"), F.lit(SAME_AUTHOR).alias("reason")))
    after = matches.join(lost, "professor_id", "left")
    after = after.withColumn("evidence", F.when(F.col("canonical").isNotNull(), evidence).otherwise(F.col("evidence"))).withColumn("match_status", F.when(F.col("canonical").isNotNull(), "duplicate").otherwise(F.col("match_status")))
    return people, after.select(matches.columns)


def reset_author_duplicates(people: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo the author rule before it runs again: people are free, their duplicate
    matches unmatched."""
    stale = F.col("duplicate_reason").eqNullSafe(SAME_AUTHOR)
    freed = people.where(stale).select("professor_id", F.lit(True).alias("freed"))
    people = people.withColumn("duplicate_of", F.when(~stale, F.col("duplicate_of"))).withColumn("duplicate_reason", F.when(~stale, F.col("duplicate_reason")))
    hit = F.col("freed").isNotNull() & (F.col("match_status") == "duplicate")
    after = matches.join(freed, "professor_id", "left")
    evidence = F.to_json(F.struct(F.lit(SAME_AUTHOR).alias("reason"), F.lit(True).alias("reset")))
    after = after.withColumns({"evidence": F.when(hit, evidence).otherwise(F.col("evidence")), "author_id": F.when(~hit, F.col("author_id")), "match_score": F.when(~hit, F.col("match_score")), "match_status": F.when(hit, "unmatched").otherwise(F.col("match_status"))})
    return people, after.select(matches.columns)


def sync_duplicates(people: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of people known to be duplicates say so."""
    known = people.where(F.col("duplicate_of").isNotNull()).select("professor_id", "duplicate_of", "duplicate_reason")
    after = matches.join(known, "professor_id", "left")
    hit = F.col("duplicate_of").isNotNull()
    evidence = F.to_json(F.struct("duplicate_of", F.col("duplicate_reason").alias("reason")))
    return after.withColumns({"evidence": F.when(hit, evidence).otherwise(F.col("evidence")), "match_status": F.when(hit, "duplicate").otherwise(F.col("match_status"))}).select(matches.columns)


# Letters from rare to common in names.
RARE_FIRST = "qxzjvfwpkbygmcudhtolsrniea"


def _marks(name: str, least: float):
    """The rarest letters of a name, each with how often it has occurred before: two names
    whose letters reach the ratio ``least`` have one of these in common.  Of n letters the
    other name has at least n * least / (2 - least)."""
    letters = F.array_sort(F.split(name, ""), lambda a, b: _rarity(a) - _rarity(b))
    numbered = F.transform(letters, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(letters, 1, i), lambda x: x == c)).alias("k")))
    n = F.char_length(name)
    return F.slice(numbered, 1, n - F.ceil(n * F.lit(least / (2 - least)) - 1e-9).cast("int") + 1)


def _rarity(c):
    """A letter's place in RARE_FIRST; what is no letter comes first, by its code."""
    at = F.instr(F.lit(RARE_FIRST), c)
    return F.when(at > 0, at + 2_000_000).otherwise(F.ascii(c))


#: People of a name that are met with others at once; pairs of a task, about.
BLOCK, TASK_PAIRS = 2048, 1 << 21


def similar_people(people: DataFrame, least: float = 0.84) -> DataFrame:
    """(a, b, similarity): pairs of people of one university, a < b, whose names are similar
    to at least ``least``.  Names are compared once, however many people have them, in each
    order that occurs; the pairs of people come from a last join, by blocks of a name's people."""
    rows = people.select("professor_id", "university_id", F.array_join(names.name_tokens(F.col("name")), " ").alias("whole")).where("whole != ''")
    counted = cut(rows.groupBy("university_id", "whole").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n"), F.min("professor_id").alias("lo"), F.max("professor_id").alias("hi")))
    side = lambda l, r: [F.col(f"{l}.whole").alias("l"), F.col(f"{r}.whole").alias("r"), F.col(f"{l}.blocks").alias("l_blocks"), F.col(f"{r}.blocks").alias("r_blocks"), (F.col(f"{l}.n") * F.col(f"{r}.n")).alias("n"), (F.col(f"{l}.lo") < F.col(f"{r}.hi")).alias("occurs")]
    pairs = counted.select("university_id", F.struct(counted.columns[1:]).alias("x")).where(F.lit(least <= 1)).select("university_id", *side("x", "x"), F.lit(1.0).alias("similarity"))
    if least < 1:  # other names are alike to less than 1
        met = _met(counted, least)
        both = met.select("university_id", *side("x", "y")).unionByName(met.select("university_id", *side("y", "x"))).where("occurs")
        pairs = pairs.unionByName(both.withColumn("similarity", names.name_similarity(F.split("l", " "), F.split("r", " "), least)))
    found = cut(pairs.where("occurs").where(F.col("similarity") >= least))
    tasks = max(1, -(-(found.agg(F.sum("n")).first()[0] or 0) // TASK_PAIRS))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    dealt = rows.join(counted.select("university_id", "whole", "blocks"), ["university_id", "whole"]).select("university_id", "whole", "professor_id", F.pmod(F.xxhash64("professor_id"), "blocks").alias("block"))
    left = found.select("university_id", "l", "r", "similarity", each("r_blocks").alias("j")).join(dealt.select("university_id", F.col("whole").alias("l"), F.col("block").alias("i"), F.col("professor_id").alias("a")), ["university_id", "l"])
    right = found.select("university_id", "l", "r", each("l_blocks").alias("i")).join(dealt.select("university_id", F.col("whole").alias("r"), F.col("block").alias("j"), F.col("professor_id").alias("b")), ["university_id", "r"])
    key = ["university_id", "l", "r", "i", "j"]
    out = left.repartition(tasks, *key).hint("merge").join(right.repartition(tasks, *key), key).where("a < b")
    return out.select("a", "b", "similarity")


def _met(counted: DataFrame, least: float) -> DataFrame:
    """(university_id, x, y): pairs of rows of different names that share a rare letter of the
    first few, or last name and first initial.  Only such may reach ``least``."""
    tokens = F.split("whole", " ")
    initial = F.concat(F.lit("k"), F.substring("whole", 1, 1), F.lit(" "), F.get(tokens, F.size(tokens) - 1))
    marks = F.transform(_marks("whole", least), lambda m: F.concat(F.lit("m"), m["c"], m["k"].cast("string")))
    keys = counted.select("university_id", F.struct(counted.columns[1:]).alias("x"), F.explode(F.array_union(marks, F.array(initial))).alias("key"))
    return keys.join(keys.withColumnRenamed("x", "y"), ["university_id", "key"]).where("x.whole < y.whole").select("university_id", "x", "y").distinct()
