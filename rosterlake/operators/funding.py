"""Grants of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NIH = "project_num string, applied_serial_num string, project_title string, award_amount double, award_amount_per_year double, project_start_date string, project_end_date string, principal_investigators array<struct<full_name:string>>"
NSF = "id string, title string, fundsObligatedAmt double, funds double, startDate string, expDate string, piFirstName string, piLastName string"
GRANT = ["source", "grant_id", "title", "pi_name", "amount", "start_date", "end_date"]


def _day(date: Column) -> Column:
    return F.when(date != "", F.substring(date, 1, 10))


def _inner_date(date: Column) -> Column:
    """A date, or what a {"date": ...} object holds."""
    return F.when(date.startswith("{"), F.get_json_object(date, "$.date")).otherwise(date)


def parse_nih(projects: DataFrame, *carried: str) -> DataFrame:
    """Grant rows of project payloads; columns named in ``carried`` stay beside them."""
    amount = F.coalesce(F.nullif("award_amount", F.lit(0.0)), F.col("award_amount_per_year"))
    pi = F.coalesce(F.get("principal_investigators", F.lit(0))["full_name"], F.lit(""))
    key = F.coalesce("applied_serial_num", "project_num", F.lit(""))
    return projects.select(*carried, F.lit("nih").alias("source"), key.alias("grant_id"), F.coalesce("project_title", F.lit("")).alias("title"), pi.alias("pi_name"), amount.alias("amount"), _day(F.col("project_start_date")).alias("start_date"), _day(F.col("project_end_date")).alias("end_date"))


def parse_nsf(awards: DataFrame, *carried: str) -> DataFrame:
    amount = F.coalesce(F.nullif("fundsObligatedAmt", F.lit(0.0)), F.col("funds"))
    pi = F.trim(F.concat(F.coalesce("piFirstName", F.lit("")), F.lit(" "), F.coalesce("piLastName", F.lit(""))))
    return awards.select(*carried, F.lit("nsf").alias("source"), F.coalesce("id", F.lit("")).alias("grant_id"), F.coalesce("title", F.lit("")).alias("title"), pi.alias("pi_name"), amount.alias("amount"), _day(_inner_date(F.col("startDate"))).alias("start_date"), _day(_inner_date(F.col("expDate"))).alias("end_date"))


def grants(nih: DataFrame, nsf: DataFrame) -> DataFrame:
    """All grants of both sources, repeats included."""
    return nih.unionByName(nsf)


def is_active(end_date: Column, today: Column | str) -> Column:
    """Whether a grant ends today or later; ISO dates compare as text."""
    return F.coalesce((end_date != "") & (end_date >= (F.lit(today) if isinstance(today, str) else today)), F.lit(False))


def funding_summary(rows: DataFrame, today: str) -> DataFrame:
    """(professor_id, total_funding, grants, actively_funded)."""
    return rows.groupBy("professor_id").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_funding"), F.count("*").alias("grants"), F.bool_or(is_active(F.col("end_date"), today)).alias("actively_funded"))


def grants_by_end(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Grants of each person, the one that ends last first, those without an end last;
    ``place`` counts from 1."""
    order = Window.partitionBy("professor_id").orderBy(F.desc_nulls_last("end_date"), "source", "grant_id")
    out = rows.withColumn("place", F.row_number().over(order))
    return out if n is None else out.where(F.col("place") <= n)


def to_look_up(people: DataFrame, universities: DataFrame) -> DataFrame:
    """(professor_id, name, institution) of verified canonical people."""
    ready = people.where((F.col("verification_status") == "verified") & F.col("duplicate_of").isNull())
    return ready.join(universities.select("university_id", F.col("name").alias("institution")), "university_id").select("professor_id", "name", "institution")


def last_grants(new: DataFrame) -> DataFrame:
    """One row a grant, the last found."""
    key = ["source", "grant_id"]
    return new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in (*key, "seq")]), "seq").alias("n")).select(*key, "n.*")


def upsert_grants(old: DataFrame, new: DataFrame) -> DataFrame:
    """Grants by (source, grant_id): new values, but the person a grant was first
    found for keeps it."""
    key, last = ["source", "grant_id"], last_grants(new)
    kept = old.select(*key, F.col("professor_id").alias("owner"))
    changed = last.join(kept, key, "left").withColumn("professor_id", F.coalesce("owner", "professor_id")).drop("owner")
    return old.join(last.select(key), key, "left_anti").select(old.columns).unionByName(changed.select(old.columns))
