"""Does search find whom it should?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import patterns
from ..scratch import cut

EXPECTED = "query_id bigint, query string, notes string, expected_professors array<string>, expected_universities array<string>, minimum_professor_matches int, minimum_university_matches int"


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a JSON array file, numbered in its order, or of files of JSON lines, which
    tell their number in ``pos`` and are read in as many tasks as they fill.  An entry needs
    a query that is not empty."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    body = EXPECTED.replace("query_id bigint, ", "")
    if first and first[0][0].lstrip().startswith("["):
        kind = StructType.fromDDL(body)
        items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", ArrayType(kind), {"mode": "FAILFAST"})).alias("query_id", "q")).select(F.col("query_id").cast("bigint").alias("query_id"), "q.*")
    elif first and not first[0][0].lstrip().startswith("{"):
        raise ValueError("an evaluation file is a JSON array, or JSON lines")
    else:
        items = spark.read.schema(f"pos bigint, {body}").option("mode", "FAILFAST").json(path).withColumnRenamed("pos", "query_id")
    if not items.where(F.coalesce("query", F.lit("")) == "").limit(1).isEmpty():
        raise ValueError("an evaluation entry has a query that is not empty")
    none = F.array().cast("array<string>")
    return items.select("query_id", "query", F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("expected_professors", none).alias("expected_professors"), F.coalesce("expected_universities", none).alias("expected_universities"), "minimum_professor_matches", "minimum_university_matches")


def matched(queries: DataFrame, expected: str, hits: DataFrame, value: str) -> DataFrame:
    """(query_id, matched): a query's patterns, in order, that a value of its hits contains,
    in any case.  All patterns of all queries are looked for in one pass over the values."""
    asked = queries.select("query_id", F.posexplode(expected).alias("pos", "as_given")).withColumn("pattern", F.lower("as_given"))
    seen = hits.select("query_id", F.lower(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    found = patterns.pairs(seen.select("value").distinct(), "value", "value", asked.select("pattern"))
    met = asked.join(found, "pattern").join(seen, ["query_id", "value"]).select("query_id", "pos", "as_given").distinct()
    return met.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "as_given"))).alias("m")).select("query_id", F.transform("m", lambda m: m["as_given"]).alias("matched"))


def evaluate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each query: matched and missing names, and hit_at_k (null without
    expectations).  The hits are searched for once."""
    none, rows, hits = F.array().cast("array<string>"), queries, cut(hits.select("query_id", "professor_name", "university_name"))
    for kind in ("professor", "university"):
        name = {"professor": "professors", "university": "universities"}[kind]
        own = matched(queries, f"expected_{name}", hits, f"{kind}_name").withColumnRenamed("matched", f"matched_{name}")
        rows = rows.join(own, "query_id", "left").withColumn(f"matched_{name}", F.coalesce(f"matched_{name}", none))
        rows = rows.withColumn(f"missing_{name}", F.array_except(f"expected_{name}", f"matched_{name}"))
        least = F.greatest(F.col(f"minimum_{kind}_matches"), F.lit(0))
        rows = rows.withColumn(f"need_{kind}", F.coalesce(F.when(F.col(f"minimum_{kind}_matches").isNotNull(), least), F.when(F.size(f"expected_{name}") > 0, 1).otherwise(0)))
    labelled = (F.size("expected_professors") > 0) | (F.size("expected_universities") > 0)
    met = (F.size("matched_professors") >= F.col("need_professor")) & (F.size("matched_universities") >= F.col("need_university"))
    shown = lambda kind, name: F.when(F.size(f"expected_{name}") > 0, F.col(f"need_{kind}")).otherwise(0).alias(f"minimum_{kind}_matches")
    return rows.select("query_id", "query", "notes", "expected_professors", "expected_universities", shown("professor", "professors"), shown("university", "universities"), "matched_professors", "missing_professors", "matched_universities", "missing_universities", F.when(labelled, met).alias("hit_at_k"))


def summarize(results: DataFrame) -> DataFrame:
    """One row: totals, labelled queries, hits, misses, share of hits."""
    labelled, hit = F.count_if(F.col("hit_at_k").isNotNull()), F.count_if(F.col("hit_at_k"))
    return results.agg(
        F.count("*").alias("total_queries"),
        labelled.alias("labeled_queries"),
        hit.alias("queries_with_expected_hits"),
        (labelled - hit).alias("queries_with_expected_misses"),
        F.round(F.try_divide(hit, labelled), 4).alias("expected_hit_rate"),
    )
