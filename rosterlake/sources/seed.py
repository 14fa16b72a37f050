"""Universities and their roster pages from a seed file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import host_allowed

SEED = "name string, short_name string, qs_rank_2026 int, qs_score double, domain string, openalex_id string, ror_id string, state string, seed_status string, departments array<struct<department_type:string,roster_url:string,parser_hint:string>>"
ATTRIBUTES = ["short_name", "qs_rank_2026", "qs_score", "domain", "openalex_id", "ror_id", "state"]


def read_seed(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Entries of a JSON array, in the order of the file (``pos``), or of files of JSON
    lines, which tell their own ``pos`` and are read in as many tasks as they fill; the
    first few."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if first and first[0][0].lstrip().startswith("["):
        text = spark.read.text(path, wholetext=True)
        items = text.select(F.posexplode(F.from_json("value", f"array<struct<{_ddl(SEED)}>>")).alias("pos", "s")).select("pos", "s.*")
        return items if limit is None else items.where(F.col("pos") < limit)
    items = spark.read.schema(f"pos int, {SEED}").json(path)
    return items if limit is None else items.orderBy(F.asc_nulls_last("pos"), "name").limit(limit)


def _ddl(schema: str) -> str:
    out, depth = "", 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        out += c
    parts, held, depth = [], "", 0
    for c in out:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(held)
            held = ""
        else:
            held += c
    return ",".join(p.strip().replace(" ", ":", 1) for p in [*parts, held])


def universities(seed: DataFrame) -> DataFrame:
    return seed.select("name", *ATTRIBUTES)


def sources(seed: DataFrame) -> DataFrame:
    """A row for each roster page: university name, domain, department, URL, hint."""
    rows = seed.select("name", "domain", F.explode("departments").alias("d"))
    return rows.select(F.col("name").alias("university"), "domain", "d.department_type", "d.roster_url", "d.parser_hint")


def needs_scrape(sources: DataFrame) -> DataFrame:
    """Sources that have not been read, or failed when they were."""
    return sources.where(F.col("status").isin("pending", "error"))


def placed(sources: DataFrame, universities: DataFrame) -> DataFrame:
    """Sources with their university's id; those of an unknown university leave."""
    return sources.join(universities.select("university_id", F.col("name").alias("university")), "university")


def off_domain(rows: DataFrame) -> DataFrame:
    """Roster pages outside their university's domain; a load refuses these."""
    return rows.where(~host_allowed(F.col("roster_url"), F.array("domain")))


def merge_universities(old: DataFrame, seed: DataFrame, changed: DataFrame) -> DataFrame:
    """Universities by name with the seed's attributes.  Status goes back to pending
    for new ones and for those named in ``changed`` (a new or changed source)."""
    new = universities(seed).withColumn("in_seed", F.lit(True))
    there = old.select("name", F.col("status").alias("old_status"), *[F.col(a).alias(f"old_{a}") for a in ATTRIBUTES])
    rows = new.join(there, "name", "full_outer").join(changed.select("name").distinct().withColumn("changed", F.lit(True)), "name", "left")
    kept = [F.when(F.col("in_seed"), F.col(a)).otherwise(F.col(f"old_{a}")).alias(a) for a in ATTRIBUTES]
    status = F.when(F.col("old_status").isNull() | F.col("changed"), "pending").otherwise(F.col("old_status"))
    return rows.select("name", *kept, status.alias("status"))


def merge_sources(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, universities with a new or changed one).  A source is told by
    university, department and URL; another hint queues it again."""
    key = ["university", "department_type", "roster_url"]
    there = old.select(*key, F.col("parser_hint").alias("old_hint"), F.col("status").alias("old_status"), "error_message", F.lit(True).alias("was_there"))
    rows = new.select(*key, "parser_hint").distinct().join(there, key, "left")
    fresh = F.col("was_there").isNull() | ~F.col("parser_hint").eqNullSafe(F.col("old_hint"))
    rows = rows.withColumn("fresh", fresh)
    merged = rows.select(*key, "parser_hint", F.when(fresh, "pending").otherwise(F.col("old_status")).alias("status"), F.when(~fresh, F.col("error_message")).alias("error_message"))
    untouched = old.join(new.select(key), key, "left_anti").select(merged.columns)
    return untouched.unionByName(merged), rows.where("fresh").select(F.col("university").alias("name"))
