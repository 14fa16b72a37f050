"""People by a part of their name, through postings of trigrams.

``postings`` is a table made once: a row for each person and each different run of three
characters of their lower-cased name, in buckets by the run.  A looked-up text, in which %
stands for any text and _ for any character, has literal pieces; whoever has them has all
trigrams of all pieces.  So only the buckets of these are read, people who have them all
are counted out, and their names are compared as ``ILIKE`` does.  A text without a piece of
three characters is compared with all names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import contains_name

#: Buckets of a postings table, a folder each.
BUCKETS = 64


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    many = F.char_length(low) - 2
    return F.when(many > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def postings(people: DataFrame) -> DataFrame:
    """(trigram, professor_id, bucket)."""
    rows = people.select(F.explode(trigrams(F.col("name"))).alias("trigram"), "professor_id")
    return rows.withColumn("bucket", bucket(F.col("trigram")))


def write(people: DataFrame, path: str) -> DataFrame:
    """The postings of ``people`` as files below ``path``, a folder a bucket, by trigram."""
    postings(people).repartition("bucket").sortWithinPartitions("bucket", "trigram", "professor_id").write.partitionBy("bucket").parquet(path)
    return people.sparkSession.read.schema(postings(people).schema).parquet(path)


def pieces(part: str) -> list[str] | None:
    """Trigrams that a name must have to contain ``part``; None if that tells nothing, or
    where a backslash makes a % or _ literal."""
    if "\\" in part:
        return None
    found = {p[i : i + 3] for p in re.split("[%_]", part) for i in range(len(p) - 2)}
    return sorted(found) or None


def candidates(spark: SparkSession, index: DataFrame | Callable[[DataFrame], DataFrame], part: str) -> DataFrame | None:
    """(professor_id) of those who have all trigrams of ``part``; None for all people.
    ``index``: a postings table, or what gives its rows for a table of trigrams."""
    wanted = pieces(part)
    if wanted is None:
        return None
    # Spark's lower case, as the names have it; the plan gets the values, for the scan's sake
    low = spark.createDataFrame([(w,) for w in wanted], "w string").select(F.lower("w").alias("w"))
    rows = low.where(F.char_length("w") == 3).distinct().select("w", bucket(F.col("w")).alias("b")).collect()
    if not rows:
        return None
    if callable(index):
        own = index(spark.createDataFrame([(r["w"],) for r in rows], "trigram string"))
    else:
        own = index.where(F.col("bucket").isin(sorted({r["b"] for r in rows})) & F.col("trigram").isin([r["w"] for r in rows]))
    return own.groupBy("professor_id").agg(F.count("*").alias("n")).where(F.col("n") == len(rows)).select("professor_id")


def by_name(people: DataFrame, index: DataFrame | Callable[[DataFrame], DataFrame], part: str) -> DataFrame:
    """The people whose name contains ``part``, in order of id."""
    some = candidates(people.sparkSession, index, part)
    rows = people if some is None else people.join(some, "professor_id", "left_semi")
    return rows.where(contains_name(F.col("name"), part)).orderBy("professor_id")
