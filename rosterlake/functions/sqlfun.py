"""The text, scoring and matching functions for those who write SQL.

``register`` makes them temporary functions of a session, with SQL bodies, so that Spark
sees through them as it does through columns: filters are pushed down and columns pruned.
Only the decomposition of accents is a Python function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import scoring, text


def _titles() -> str:
    """The first pattern that a title contains decides."""
    rules = [(p, "excluded") for p in text.EXCLUDED_TITLES] + [(p, "ambiguous") for p in text.AMBIGUOUS_TITLES] + [(p, "verified") for p, _ in text.VERIFIED_TITLES]
    whens = " ".join(f"WHEN contains(lower(norm_space(x)), '{p}') THEN '{status}'" for p, status in rules)
    return f"CASE {whens} ELSE 'ambiguous' END"


_LONG = "length(w) > 4"
_TERMS = "array_distinct(filter(q, t -> length(t) > 2))"
_WEIGHTS = ", ".join(f"{w}D" for w in scoring.TOP_WORK_WEIGHTS)

#: name: arguments, result, body.  A later one may use those before it.
FUNCTIONS = {
    "norm_space": ("x STRING", "STRING", r"trim(regexp_replace(coalesce(x, ''), '(?U)\\s+', ' '))"),
    "first_email": ("x STRING", "STRING", "nullif(lower(regexp_extract(coalesce(x, ''), '" + text.EMAIL.replace("\\", "\\\\") + "', 0)), '')"),
    "plain_name": ("x STRING", "STRING", r"lower(regexp_replace(unaccented(norm_space(x)), '[^A-Za-z0-9\\s-]', ''))"),
    "title_status": ("x STRING", "STRING", _titles()),
    "search_terms": ("x STRING", "ARRAY<STRING>", f"transform(regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9]+', 0), w -> CASE WHEN {_LONG} AND endswith(w, 'ies') THEN concat(left(w, length(w) - 3), 'y') WHEN {_LONG} AND endswith(w, 's') AND NOT endswith(w, 'ss') THEN left(w, length(w) - 1) ELSE w END)"),
    "is_preprint": ("source_name STRING, doi STRING", "BOOLEAN", "contains(lower(coalesce(source_name, '')), 'arxiv') OR contains(lower(coalesce(doi, '')), '10.48550/arxiv')"),
    "keyword_share": ("q ARRAY<STRING>, x ARRAY<STRING>", "DOUBLE", f"CASE WHEN size({_TERMS}) > 0 THEN size(array_intersect({_TERMS}, x)) / size({_TERMS}) ELSE 0D END"),
    "phrase_share": ("q ARRAY<STRING>, x ARRAY<STRING>", "DOUBLE", "CASE WHEN size(filter(q, t -> length(t) > 2)) >= 2 AND contains(array_join(x, ' '), array_join(filter(q, t -> length(t) > 2), ' ')) THEN 1D ELSE 0D END"),
    "dot_of": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine_of": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) > 0 AND size(a) = size(b) AND dot_of(a, a) > 0 AND dot_of(b, b) > 0 THEN dot_of(a, b) / (sqrt(dot_of(a, a)) * sqrt(dot_of(b, b))) ELSE 0D END"),
    "work_score": ("semantic DOUBLE, q ARRAY<STRING>, title ARRAY<STRING>, abstract ARRAY<STRING>", "DOUBLE", "0.65D * semantic + 0.2D * keyword_share(q, title) + 0.1D * keyword_share(q, abstract) + 0.05D * greatest(phrase_share(q, title), 0.5D * phrase_share(q, abstract))"),
    "best_sum": ("scores ARRAY<DOUBLE>, k INT", "DOUBLE", f"aggregate(transform(slice(sort_array(scores, false), 1, least(k, {len(scoring.TOP_WORK_WEIGHTS)})), (s, i) -> s * get(array({_WEIGHTS}), i)), 0D, (a, x) -> a + x)"),
    "active_grant": ("end_date STRING, today STRING", "BOOLEAN", "coalesce(end_date <> '' AND end_date >= today, false)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names."""
    spark.udf.register("unaccented", text.unaccented)
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return ["unaccented", *FUNCTIONS]
