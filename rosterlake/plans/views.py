"""A people corpus seen in the general tables.

Each view is one SELECT that Spark and DuckDB read alike; ``{name}`` stands for a
table.  ``view(spark, sf_dir, name)`` is the DataFrame, ``cte(names)`` the same as
common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "universities": "SELECT n_nationkey AS university_id, n_name AS name, n_regionkey AS region_id FROM {nation}",
    "people": """
SELECT s_suppkey AS professor_id, s_nationkey AS university_id, s_name AS name, lower(s_name) AS normalized_name,
  CASE s_suppkey % 4 WHEN 0 THEN 'physics' WHEN 1 THEN 'applied_physics' WHEN 2 THEN 'astronomy' ELSE 'materials_science' END AS department_type,
  CASE WHEN s_acctbal < 0 THEN 'excluded' WHEN s_acctbal < 500 THEN 'ambiguous' ELSE 'verified' END AS verification_status,
  CASE WHEN s_suppkey % 11 = 10 THEN s_suppkey - 10 END AS duplicate_of,
  CASE WHEN s_suppkey % 11 = 10 THEN 'same_university_name' END AS duplicate_reason,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Professor of attion and thanedble studies' ELSE 'Professor' END AS title,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://example.org/' || s_name END AS profile_url,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Interests: thinor, ertion, thanea and ereding' ELSE 'zzyzx qwfpg' END AS profile_text,
  CASE WHEN s_suppkey % 5 = 0 THEN 'eriner thernd; eriner ating' ELSE '' END AS source_snippet
FROM {supplier}""",
    "matches": """
SELECT s_suppkey AS professor_id,
  CASE s_suppkey % 6 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unmatched' WHEN 2 THEN 'manual_override' ELSE 'matched' END AS match_status,
  CASE WHEN s_suppkey % 6 > 1 AND s_suppkey % 13 > 0 THEN 'A' || CAST(s_suppkey % 7 AS VARCHAR(20)) END AS author_id,
  CAST(s_suppkey % 50 AS DOUBLE) / 50 AS match_score, CAST('' AS VARCHAR(20)) AS evidence
FROM {supplier} WHERE s_suppkey % 17 > 0""",
    "works": """
SELECT doc_id AS work_id, split_part(coalesce(text, ''), '\n', 1) AS title,
  substr(coalesce(text, ''), length(split_part(coalesce(text, ''), '\n', 1)) + 2) AS abstract,
  CASE WHEN doc_id % 9 > 0 THEN CAST(2000 + doc_id % 26 AS INT) END AS publication_year, n_chars AS cited_by_count,
  CASE WHEN doc_id % 7 = 0 THEN '10.48550/arXiv.' || CAST(doc_id AS VARCHAR(20)) END AS doi,
  CASE WHEN doc_id % 5 = 0 THEN 'arXiv preprint' ELSE source END AS source_name,
  '[{{"display_name":"' || lang || '"}},{{"name":"topic"}}]' AS topics_json
FROM {documents}""",
    "links": """
SELECT doc_id % n AS professor_id, doc_id AS work_id FROM {documents}, (SELECT count(*) AS n FROM {supplier}) s
UNION
SELECT (7 * doc_id + 3) % n AS professor_id, doc_id AS work_id FROM {documents}, (SELECT count(*) AS n FROM {supplier}) s""",
    "members": """
SELECT p_partkey AS professor_id, CAST(p_partkey % 5 AS INT) AS university_id, p_name AS name, lower(p_name) AS normalized_name, p_type || ' professor' AS title,
  CASE WHEN p_size % 10 = 0 THEN 'excluded' ELSE 'verified' END AS verification_status,
  CASE WHEN p_size % 3 = 0 THEN 'https://example.org/' || p_brand ELSE '' END AS profile_url,
  CASE WHEN p_size = 7 THEN p_partkey + 1 END AS duplicate_of,
  CASE WHEN p_size = 7 THEN 'same_university_name' END AS duplicate_reason
FROM {part}""",
    # authors that a search by each of two spellings of a person's name found; the kind tells
    # how the record's name differs
    "author_records": """
SELECT c_custkey % n AS professor_id, v.variant, CAST(floor(c_custkey / n) AS INT) AS pos, 'A' || CAST(c_custkey AS VARCHAR(20)) AS author_id, CAST((c_custkey + floor(c_custkey / n)) % 5 AS INT) AS kind,
  CASE CAST((c_custkey + floor(c_custkey / n)) % 5 AS INT) WHEN 0 THEN 'Ann Bea ' || s_name WHEN 1 THEN 'A. B. ' || s_name WHEN 2 THEN 'Ann Clara ' || s_name WHEN 3 THEN 'Prof. Ann ' || s_name ELSE 'Zzz Qq' END AS display_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'I' || CAST(s_nationkey AS VARCHAR(20)) END AS institution,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Quantum materials' ELSE 'Cosmology' END AS topic,
  CAST(2019 + c_custkey % 8 AS INT) AS year, CASE WHEN c_custkey % 5 > 0 THEN 2 ELSE 0 END AS works_count
FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) s JOIN {supplier} p ON s_suppkey = c_custkey % n CROSS JOIN (SELECT 0 AS variant UNION ALL SELECT 1) v
WHERE v.variant = 0 OR c_custkey % 3 > 0""",
    "grants": """
SELECT o_orderkey AS grant_row, o_custkey AS professor_id, 'order' AS source, CAST(o_orderkey AS VARCHAR(20)) AS grant_id,
  CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS amount,
  CASE WHEN o_orderkey % 10 > 0 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS end_date
FROM {orders}""",
}


def fed(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` if its files are fewer than the session's cores: a
    small table in one file would else be worked on by one task.  Many files need no
    shuffle for that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "documents":
        return fed(spark.read.parquet(f"{sf_dir}/{name}.parquet"), "doc_id")
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"(?<!\{)\{(\w+)\}", text)}
    if name == "works":
        used["documents"] = fed(used["documents"], "doc_id")
    return spark.sql(text, **used)


def cte(*names: str) -> str:
    """The views, for DuckDB, ready for ", more AS (...)" or a SELECT."""
    parts = []
    for n in names:
        body = re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]).replace("'\\n'", "chr(10)").replace("{{", "{").replace("}}", "}")
        parts.append(f"{n} AS ({body})")
    return "WITH " + ", ".join(parts)
