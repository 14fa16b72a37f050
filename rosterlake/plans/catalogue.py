"""Queries by name, and the SQL that must give the same rows.

Lists come out as text (items joined by "|") and scores rounded, so that values
compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, patterns, scoring, sqlfun, text, vectors
from ..operators import audit, cosinetop, evaluate, funding, identity, inspect, nameindex, resolve, search, works
from ..operators.audit import AUDIT_WORDS
from ..sources import pages as page_source
from ..sources import seed
from ..scratch import cut, filed, scratch_path
from ..streaming.latest import last_words
from . import store
from .views import cte, view

DIM = 64
QUERY = "Eriner thanedble attion QM"
TODAY = "1999-06-01"
_found: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def keep(f):
        _found[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def joined(column):
    return F.array_join(column, "|")


# -- SQL pieces


def sql_tokens(x: str) -> str:
    w = "length(w) > 4"
    return f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: CASE WHEN {w} AND ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3) || 'y' WHEN {w} AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN substr(w, 1, length(w) - 1) ELSE w END)"


def sql_normal_query(x: str) -> str:
    return f"replace(replace(replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'qm', 'quantum materials'), 'cmb', 'condensed matter'), 'astro', 'astrophysics')"


def sql_keyword(q: str, t: str) -> str:
    terms = f"list_distinct(list_filter({q}, lambda t: length(t) > 2))"
    return f"CASE WHEN len({terms}) > 0 THEN len(list_intersect({terms}, {t})) / len({terms}) ELSE 0.0 END"


def sql_phrase(q: str, t: str) -> str:
    terms = f"list_filter({q}, lambda t: length(t) > 2)"
    return f"CASE WHEN len({terms}) >= 2 AND contains(array_to_string({t}, ' '), array_to_string({terms}, ' ')) THEN 1.0 ELSE 0.0 END"


def sql_components(rows: str) -> str:
    """CTEs that end in ``parts`` (k, bucket, value) for ``rows`` (k, body)."""
    word = "substr(d, 8 * i + 1, 8)"
    return f"""
bag AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(string_split_regex(lower(body), '\\s+')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL),
digests AS (SELECT w, sha256(w) AS d FROM (SELECT DISTINCT w FROM bag)),
known AS (SELECT w, CAST(('0x' || {word})::BIGINT % {DIM} AS INT) AS bucket, CASE WHEN ('0x' || substr(d, 8 * i + 1, 2))::INT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM digests, range(8) r(i)),
parts AS (SELECT k, bucket, CAST(sum(n * sign) AS BIGINT) AS value FROM bag JOIN known USING (w) GROUP BY ALL HAVING sum(n * sign) <> 0)"""


#: Cosines of hash embeddings, sparse.
SQL_HASHED = f"""{sql_components("texts")},
norms AS (SELECT k, sqrt(CAST(sum(value * value) AS DOUBLE)) AS norm FROM parts GROUP BY k),
cosines AS (SELECT a.k AS qk, b.k AS wk, CAST(sum(a.value * b.value) AS DOUBLE) / (max(na.norm) * max(nb.norm)) AS semantic
  FROM parts a JOIN parts b ON a.bucket = b.bucket AND a.k LIKE 'q%' AND b.k LIKE 'w%' JOIN norms na ON na.k = a.k JOIN norms nb ON nb.k = b.k GROUP BY 1, 2)"""
#: Cosines of an encoder that counts some letters.
LETTERS = "aeiounrst"
SQL_LETTERS = f"""
dense AS (SELECT k, [{", ".join(f"CAST(length(body) - length(replace(body, '{c}', '')) AS DOUBLE)" for c in LETTERS)}, 1.0] AS v FROM texts),
cosines AS (SELECT a.k AS qk, b.k AS wk, list_cosine_similarity(a.v, b.v) AS semantic FROM dense a JOIN dense b ON a.k LIKE 'q%' AND b.k LIKE 'w%')"""


def sql_search(queries: str, cosines: str = SQL_HASHED) -> str:
    """CTEs that end in ``ranked`` (query_id, professor_id, work_id, title_key,
    work_score, place) for ``queries`` (query_id, q)."""
    body = "trim(coalesce(title, '') || ' [SEP] ' || substr(coalesce(abstract, ''), 1, 1024))"
    key = sql_tokens("regexp_replace(replace(title, '&amp;', '&'), '<[^>]+>', ' ', 'g')")
    return f"""{cte("universities", "people", "works", "links")}, queries AS ({queries}),
texts AS (SELECT 'w' || work_id AS k, {body} AS body FROM works UNION ALL SELECT 'q' || query_id, q FROM queries), {cosines},
ready AS (SELECT work_id, title, publication_year, doi, source_name, {sql_tokens("title")} AS tt, {sql_tokens("abstract")} AS ta,
  CASE WHEN array_to_string({key}, ' ') <> '' THEN array_to_string({key}, ' ') ELSE CAST(work_id AS VARCHAR) END AS title_key,
  lower(coalesce(source_name, '')) LIKE '%arxiv%' OR lower(coalesce(doi, '')) LIKE '%10.48550/arxiv%' AS preprint FROM works),
asked AS (SELECT query_id, {sql_tokens("q")} AS qt FROM queries),
scored AS (SELECT query_id, ready.*, round(0.65 * coalesce(semantic, 0) + 0.2 * ({sql_keyword("qt", "tt")}) + 0.1 * ({sql_keyword("qt", "ta")})
    + 0.05 * greatest({sql_phrase("qt", "tt")}, 0.5 * {sql_phrase("qt", "ta")}), 12) AS work_score
  FROM ready, asked LEFT JOIN cosines ON qk = 'q' || query_id AND wk = 'w' || work_id),
kept AS (SELECT query_id, professor_id, scored.* EXCLUDE (query_id), row_number() OVER (PARTITION BY query_id, professor_id, title_key ORDER BY preprint, work_score DESC, length(scored.title) DESC, work_id) AS nth
  FROM scored JOIN links USING (work_id) JOIN people USING (professor_id) WHERE verification_status = 'verified' AND duplicate_of IS NULL),
ranked AS (SELECT * EXCLUDE (nth), CAST(row_number() OVER (PARTITION BY query_id, professor_id ORDER BY work_score DESC, work_id) AS INT) AS place FROM kept WHERE nth = 1)"""


ONE_QUERY = f"SELECT CAST(0 AS BIGINT) AS query_id, {sql_normal_query(chr(39) + QUERY + chr(39))} AS q"
MANY_QUERIES = f"SELECT item_id AS query_id, {sql_normal_query('text')} AS q FROM benchmark"
HITS = """, sums AS (SELECT query_id, professor_id, count(*) AS total_work_count,
  round(sum(CASE place WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.35 WHEN 4 THEN 0.2 WHEN 5 THEN 0.1 ELSE 0 END * work_score), 4) AS score FROM ranked GROUP BY ALL),
hits AS (SELECT query_id, professor_id, p.name AS professor_name, u.name AS university_name, score, total_work_count,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, professor_id) AS INT) AS rank
  FROM sums JOIN people p USING (professor_id) JOIN universities u USING (university_id))"""


# -- search


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    out = {n: view(spark, d, n) for n in ("universities", "people", "works", "links", "matches")}
    body = vectors.embedding_text(F.col("title"), F.col("abstract"))
    out["vectors"] = vectors.hash_embed(out["works"].withColumn("body", body), "work_id", "body", DIM)
    return out


def one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUERY).alias("query"))


def _search(spark: SparkSession, d: str, batch: bool = False, limit: int | None = 25) -> tuple[DataFrame, DataFrame]:
    asked = view(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")) if batch else one_query(spark)
    return search.search(tables(spark, d), asked, DIM, limit)


@query(sql_search(ONE_QUERY) + HITS + " SELECT * FROM hits WHERE rank <= 25")
def search_rank_people(spark, d):
    return _search(spark, d)[0]


@query(sql_search(MANY_QUERIES) + HITS + " SELECT * FROM hits WHERE rank <= 25")
def search_people_batch(spark, d):
    return _search(spark, d, batch=True)[0]


def count_letters():
    return lambda texts: [[*(t.count(c) for c in LETTERS), 1.0] for t in texts]


@query(sql_search(MANY_QUERIES) + HITS + " SELECT * FROM hits WHERE rank <= 25")
def search_people_indexed(spark, d):
    """The batch, over an index of prepared works: their words, title keys and vectors, made
    once.  People's profiles, which hold each work's terms once more for each of its people,
    pay for few queries only; ``search_dense_backend`` goes through them."""
    t = tables(spark, d)
    t["prepared"] = filed(search.index(t)[0], "prepared")
    asked = view(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search(t, asked, DIM)[0]


@query(sql_search(MANY_QUERIES, SQL_LETTERS) + HITS + " SELECT * FROM hits WHERE rank <= 25")
def search_dense_backend(spark, d):
    """Works and queries embedded by one encoder, beside vectors of another backend."""
    t = tables(spark, d)
    body = t["works"].withColumn("body", vectors.embedding_text(F.col("title"), F.col("abstract")))
    own = vectors.dense_embed(body, "work_id", "body", count_letters, len(LETTERS) + 1)
    t["vectors"] = t["vectors"].withColumn("backend", F.lit("hash")).unionByName(own.withColumn("backend", F.lit("letters")))
    t["prepared"], t["profiles"] = map(cut, search.index(t, "letters"))
    asked = view(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search(t, asked, len(LETTERS) + 1, backend="letters", encoders={"letters": count_letters})[0]


@query(sql_search(ONE_QUERY) + " SELECT query_id, work_id, round(work_score, 6) AS work_score, preprint FROM scored")
def search_work_scores(spark, d):
    t = tables(spark, d)
    prepared = search.prepare_works(t["works"], t["vectors"])
    scored = search.score_works(prepared, search.query_rows(one_query(spark), DIM)).join(prepared.select("work_id", "preprint"), "work_id")
    return scored.select("query_id", "work_id", F.round("work_score", 6).alias("work_score"), "preprint")


@query(sql_search(ONE_QUERY) + " SELECT professor_id, work_id, title, publication_year, doi, source_name, round(work_score, 6) AS work_score, place FROM ranked")
def search_ranked_works(spark, d):
    return _search(spark, d)[1].select("professor_id", "work_id", "title", "publication_year", "doi", "source_name", F.round("work_score", 6).alias("work_score"), "place")


@query(sql_search(ONE_QUERY) + " SELECT professor_id, work_id, place FROM ranked WHERE place > 2 AND place <= 5")
def search_work_window(spark, d):
    return search.work_window(_search(spark, d)[1], 2, 3).select("professor_id", "work_id", "place")


@query(sql_search(ONE_QUERY) + HITS + """ SELECT hits.* FROM hits JOIN people USING (professor_id) WHERE university_id = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3) AND department_type = 'materials_science' AND verification_status = 'verified'
  AND professor_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 > 2 AND s_suppkey % 17 > 0)""")
def search_all_facets(spark, d):
    """All four facets at once, over all people: of the university of one of them."""
    people = view(spark, d, "people")
    one = people.where("professor_id = 3").select("university_id").first()
    return search.facets(_search(spark, d, limit=None)[0], people, view(spark, d, "matches"), one[0] if one else -1, "materials_science", "verified", "matched")


@query(sql_search(ONE_QUERY) + HITS + ", top AS (SELECT * FROM hits WHERE rank <= 25) SELECT top.* FROM top JOIN people USING (professor_id) WHERE department_type = 'physics'")
def search_facets_after_limit(spark, d):
    return search.facets(_search(spark, d)[0], view(spark, d, "people"), department_type="physics")


@query(f"""{cte("works")}, k AS (SELECT work_id, array_to_string({sql_tokens("regexp_replace(replace(title, '&amp;', '&'), '<[^>]+>', ' ', 'g')")}, ' ') AS k, title,
  source_name LIKE 'arXiv%' OR doi IS NOT NULL AS preprint FROM works),
r AS (SELECT k AS title_key, work_id, row_number() OVER (PARTITION BY k ORDER BY preprint, length(title) DESC, work_id) AS nth, count(*) OVER (PARTITION BY k) AS copies FROM k WHERE k <> '')
SELECT title_key, work_id, copies FROM r WHERE nth = 1""")
def title_dedupe_published_over_preprint(spark, d):
    rows = view(spark, d, "works").withColumn("title_key", text.title_key(F.col("title"))).where("title_key != ''")
    order = F.struct(~text.is_preprint(F.col("source_name"), F.col("doi")), F.char_length("title"), -F.col("work_id"))
    return rows.groupBy("title_key").agg(F.max_by("work_id", order).alias("work_id"), F.count("*").alias("copies"))


# -- functions


@query(f"SELECT doc_id, array_to_string({sql_tokens('text')}, '|') AS tokens FROM documents")
def tokenize_search(spark, d):
    return view(spark, d, "documents").select("doc_id", joined(text.search_tokens(F.col("text"))).alias("tokens"))


def _overlap(spark, d, f):
    q = F.lit(QUERY)
    rows = view(spark, d, "documents")
    return rows.select("doc_id", F.round(f(text.search_tokens(q), text.search_tokens(F.col("text"))), 6).alias("overlap"))


QTOKENS = sql_tokens("'" + QUERY + "'")


@query(f"SELECT doc_id, round({sql_keyword(QTOKENS, sql_tokens('text'))}, 6) AS overlap FROM documents")
def keyword_overlap(spark, d):
    return _overlap(spark, d, scoring.keyword_overlap)


@query(f"SELECT doc_id, CAST({sql_phrase(sql_tokens(chr(39) + 'thanedble the, anea' + chr(39)), sql_tokens('text'))} AS DOUBLE) AS overlap FROM documents")
def phrase_overlap(spark, d):
    rows = view(spark, d, "documents")
    return rows.select("doc_id", scoring.phrase_overlap(text.search_tokens(F.lit("thanedble the, anea")), text.search_tokens(F.col("text"))).alias("overlap"))


@query(f"SELECT item_id, {sql_normal_query('text')} AS q FROM benchmark UNION ALL SELECT -1, {sql_normal_query(chr(39) + '  Astrophysics  of CMB and QM ' + chr(39))}")
def query_normalize(spark, d):
    rows = view(spark, d, "benchmark").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("item_id"), F.lit("  Astrophysics  of CMB and QM ").alias("text")))
    return rows.select("item_id", text.normalize_query(F.col("text")).alias("q"))


@query(f"WITH texts AS (SELECT doc_id AS k, text AS body FROM documents WHERE text IS NOT NULL), {sql_components('texts')} SELECT k AS doc_id, bucket, value FROM parts")
def hash_embed_components(spark, d):
    return vectors.hash_components(view(spark, d, "documents"), "doc_id", "text", DIM)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT e FROM v WHERE vec_id = 0)
SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS cosine FROM v, q ORDER BY cosine DESC, vec_id LIMIT 20""")
def cosine_topk(spark, d):
    rows = view(spark, d, "embeddings")
    score = F.round(vectors.cosine_to(_vector(rows, 0))(F.col("embedding")), 6).alias("cosine")
    return rows.select("vec_id", score).orderBy(F.desc("cosine"), "vec_id").limit(20)


@query(_found["cosine_topk"][1])
def cosine_topk_by_pivots(spark, d):
    """The same through an index of pivots: exact, of the vectors that can be near."""
    rows = view(spark, d, "embeddings").select("vec_id", "embedding")
    found = cosinetop.index(rows, "vec_id", scratch_path(spark, "pivots"))
    return cosinetop.nearest(found, "vec_id", _vector(rows, 0), 20)[0]


def _vector(rows: DataFrame, vec_id: int) -> list[float]:
    """A stored vector as a query; the empty one, which is like nothing, if it is missing."""
    found = rows.where(F.col("vec_id") == vec_id).select("embedding").take(1)
    return list(found[0][0]) if found else []


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 1)
SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS cosine FROM v, q""")
def cosine_native(spark, d):
    rows = view(spark, d, "embeddings").select("vec_id", "embedding")
    q = F.array(*[F.lit(float(x)) for x in _vector(rows, 1)]).cast("array<double>")
    return rows.select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("cosine"))


@query("""SELECT l_orderkey, round(sum(CASE nth WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.35 ELSE 0 END * l_quantity), 4) AS score
FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS nth FROM lineitem) GROUP BY l_orderkey""")
def discounted_topk_sum(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))
    rows = view(spark, d, "lineitem").select("l_orderkey", scoring.discounted(F.col("l_quantity"), F.row_number().over(order), 3).alias("s"))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum("s"), 4).alias("score"))


def _case(x: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{other}' END"


_TITLES = [(p, f"excluded/excluded/{p}") for p in text.EXCLUDED_TITLES] + [(p, f"ambiguous/ambiguous/{p}") for p in text.AMBIGUOUS_TITLES] + [(p, f"{k}/verified/{p}") for p, k in text.VERIFIED_TITLES]
_JOB = "CASE p_size % 7 WHEN 0 THEN 'Assistant Professor' WHEN 1 THEN 'Associate  Professor of ' || p_name WHEN 2 THEN 'Adjunct Professor' WHEN 3 THEN 'Postdoctoral Fellow' WHEN 4 THEN 'Professor Emerita' WHEN 5 THEN 'Research Scientist' ELSE p_type END"


@query(f"SELECT p_partkey, {_case('regexp_replace(lower(' + _JOB + chr(41) + ", '\\s+', ' ', 'g')", _TITLES, 'ambiguous/ambiguous/unrecognized_title')} AS decision FROM part")
def classify_title(spark, d):
    c = text.classify_title(F.expr(_JOB))
    return view(spark, d, "part").select("p_partkey", F.concat_ws("/", c["normalized_title"], c["status"], c["reason"]).alias("decision"))


@query(f"""SELECT p_partkey, coalesce({_case("lower(p_type || ' ' || p_name)", text.DEPARTMENT_ALIASES, "")}, '') AS known, replace(lower(p_name), ' ', '_') AS other FROM part""")
def department_type(spark, d):
    return view(spark, d, "part").select("p_partkey", F.when(F.lower(F.concat_ws(" ", "p_type", "p_name")).contains("physics"), "physics").otherwise("").alias("known"), text.normalize_department_type(F.col("p_name")).alias("other"))


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS normal FROM documents")
def normalize_whitespace(spark, d):
    return view(spark, d, "documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("normal"))


@query("SELECT doc_id, lower(regexp_extract(text, '[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{2,}')) AS email FROM documents WHERE regexp_matches(text, '[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{2,}')")
def normalize_email(spark, d):
    return view(spark, d, "documents").select("doc_id", text.normalize_email(F.col("text")).alias("email")).where("email IS NOT NULL")


@query("SELECT p_partkey, regexp_replace(lower(p_name || '  ' || p_brand), '[^a-z0-9\\s-]', '', 'g') AS raw, trim(regexp_replace(regexp_replace(lower(p_name || '  ' || p_brand), '\\s+', ' ', 'g'), '[^a-z0-9 -]', '', 'g')) AS normal FROM part")
def normalize_name_ascii(spark, d):
    both = F.concat(F.col("p_name"), F.lit("  "), F.col("p_brand"))
    return view(spark, d, "part").select("p_partkey", text.ascii_name(both).alias("raw"), text.normalize_name(both).alias("normal"))


@query("SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^A-Za-z0-9\\s-]', '', 'g')) AS name FROM documents")
def normalize_name_accents(spark, d):
    return view(spark, d, "documents").select("doc_id", text.ascii_name(text.strip_accents(F.col("text"))).alias("name"))


_PERSON = "CASE p_size % 4 WHEN 0 THEN 'Dr. ' || p_name WHEN 1 THEN 'Prof. ' || p_name || ' Jr.' WHEN 2 THEN p_name || ' (they/them)' ELSE 'Professor Dr ' || p_name || ' Q. III' END"
_PLAIN = "CASE p_size % 4 WHEN 3 THEN p_name || ' Q.' ELSE p_name END"


@query(f"SELECT p_partkey, {_PLAIN} AS name FROM part")
def strip_honorifics(spark, d):
    return view(spark, d, "part").select("p_partkey", names.strip_honorifics(F.expr(_PERSON)).alias("name"))


@query(f"SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN p_name || ' Q.|' || split_part(p_name, ' ', 1) || ' Q.' ELSE {_PLAIN} END AS variants FROM part")
def name_variants(spark, d):
    return view(spark, d, "part").select("p_partkey", joined(names.name_variants(F.expr(_PERSON))).alias("variants"))


# a part's two words as first and last name, with one of four middle names
_MIDDLE = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2 THEN 'bea' ELSE 'carl' END"
_FULL = f"trim(split_part(p_name, ' ', 1) || ' ' || {_MIDDLE}) || ' ' || split_part(p_name, ' ', 2)"
_NAMES = f"SELECT DISTINCT {_FULL} AS name, split_part(p_name, ' ', 1) AS f, {_MIDDLE} AS m, split_part(p_name, ' ', 2) AS l FROM part"


def _pairs(spark, d):
    n = view(spark, d, "part").select(F.expr(_FULL).alias("a")).distinct()
    left, right = names.name_tokens(F.col("a")), names.name_tokens(F.col("b"))
    pairs = n.withColumn("last", F.substring_index("a", " ", -1)).join(n.select(F.col("a").alias("b"), F.substring_index("a", " ", -1).alias("last")), "last")
    return pairs.select("a", "b", left.alias("l"), right.alias("r"))


@query(f"""WITH n AS ({_NAMES}) SELECT x.name AS a, y.name AS b, CAST(CASE WHEN x.name = y.name THEN 1.0 WHEN left(x.f, 1) <> left(y.f, 1) THEN -1
  WHEN x.m <> '' AND y.m <> '' AND x.m <> y.m AND least(x.m, y.m) || greatest(x.m, y.m) <> 'bbea' THEN 0.84
  WHEN x.f = y.f THEN 0.97 ELSE 0.89 END AS DOUBLE) AS tier FROM n x JOIN n y ON x.l = y.l""")
def name_similarity_tiers(spark, d):
    return _pairs(spark, d).select("a", "b", F.coalesce(names.similarity_tiers(F.col("l"), F.col("r")), F.lit(-1.0)).alias("tier"))


@query()
def name_similarity_full(spark, d):
    return _pairs(spark, d).select("a", "b", F.round(names.name_similarity(F.col("l"), F.col("r")), 6).alias("similarity"))


_LETTERS_IN_COMMON = "list_sum(list_transform(list_distinct(string_split(lj, '')), lambda c: least(length(lj) - length(replace(lj, c, '')), length(rj) - length(replace(rj, c, '')))))"


@query(f"""WITH names AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS nm FROM part), pairs AS (
SELECT x.id AS a, y.id AS b, x.nm AS lj, y.nm AS rj FROM names x JOIN names y ON y.id = x.id + 1)
SELECT a, b, round(2 * {_LETTERS_IN_COMMON} / (length(lj) + length(rj)), 6) AS bound FROM pairs""")
def name_ratio_bound(spark, d):
    """What the letters of two part names say of their ratio at most."""
    rows = view(spark, d, "part").select(F.col("p_partkey").alias("a"), F.lower("p_name").alias("l"))
    other = rows.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("l").alias("r"))
    return rows.join(other, "a").select("a", "b", F.round(names.ratio_bound(F.col("l"), F.col("r")), 6).alias("bound"))


@query(f"{cte('members')} SELECT x.professor_id AS a, y.professor_id AS b, CAST(1 AS DOUBLE) AS similarity FROM members x JOIN members y ON x.university_id = y.university_id AND x.professor_id < y.professor_id AND x.name = y.name")
def similar_people_exact(spark, d):
    """People of one university with the same name; at the greatest similarity only these."""
    return identity.similar_people(view(spark, d, "members"), 1.0)


# -- identity and matching


_BEST_NAME = "CASE WHEN profile_url <> '' THEN 1 ELSE 0 END DESC, length(name) DESC, length(title) DESC, professor_id"


@query(f"""{cte("members")}, v AS (SELECT professor_id, first_value(professor_id) OVER w AS best, count(*) OVER (PARTITION BY university_id, normalized_name) AS n
  FROM members WHERE verification_status = 'verified' WINDOW w AS (PARTITION BY university_id, normalized_name ORDER BY {_BEST_NAME}))
SELECT m.professor_id, CASE WHEN v.professor_id IS NULL THEN m.duplicate_of WHEN n > 1 AND best <> v.professor_id THEN best END AS duplicate_of,
  CASE WHEN v.professor_id IS NULL THEN m.duplicate_reason WHEN n > 1 AND best <> v.professor_id THEN 'same_university_name' END AS duplicate_reason
FROM members m LEFT JOIN v USING (professor_id)""")
def same_name_duplicates(spark, d):
    return identity.same_name(view(spark, d, "members")).select("professor_id", "duplicate_of", "duplicate_reason")


@query(f"""{cte("people", "matches")}, v AS (SELECT m.professor_id, first_value(m.professor_id) OVER w AS best
  FROM matches m JOIN people p USING (professor_id) WHERE match_status = 'matched' AND author_id IS NOT NULL AND duplicate_of IS NULL
  WINDOW w AS (PARTITION BY university_id % 3, author_id ORDER BY match_score DESC, CASE WHEN profile_url <> '' THEN 1 ELSE 0 END DESC, length(name) DESC, length(title) DESC, m.professor_id))
SELECT p.professor_id, coalesce(CASE WHEN best <> p.professor_id THEN best END, duplicate_of) AS duplicate_of,
  CASE WHEN best <> p.professor_id THEN 'same_author' ELSE duplicate_reason END AS duplicate_reason,
  coalesce(CASE WHEN best <> p.professor_id THEN 'duplicate' ELSE match_status END, 'none') AS match_status
FROM people p LEFT JOIN v USING (professor_id) LEFT JOIN matches m USING (professor_id)""")
def same_author_duplicates(spark, d):
    people = view(spark, d, "people").withColumn("university_id", F.col("university_id") % 3)
    people, matches = identity.same_author(people, view(spark, d, "matches"))
    rows = people.join(matches.select("professor_id", "match_status"), "professor_id", "left")
    return rows.select("professor_id", "duplicate_of", "duplicate_reason", F.coalesce("match_status", F.lit("none")).alias("match_status"))


@query(f"""{cte("people", "matches")} SELECT professor_id, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' ELSE match_status END AS match_status FROM matches JOIN people USING (professor_id)""")
def sync_duplicates(spark, d):
    return identity.sync_duplicates(view(spark, d, "people"), view(spark, d, "matches")).select("professor_id", "match_status")


def _candidates(spark, d):
    """People, and author records that searches by each one's spellings found."""
    people = view(spark, d, "supplier").select(F.col("s_suppkey").alias("professor_id"), F.concat(F.lit("Ann Bea "), F.col("s_name")).alias("name"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'physics' WHEN 1 THEN 'applied_physics' WHEN 2 THEN 'astronomy' ELSE 'materials_science' END").alias("department_type"), F.concat(F.lit("I"), F.col("s_nationkey").cast("string")).alias("institution_id"))
    found = view(spark, d, "author_records").select("professor_id", "variant", "pos", F.struct(
        F.col("author_id").alias("id"),
        "display_name",
        F.array(F.struct(F.col("institution").alias("id"))).alias("last_known_institutions"),
        F.array(F.struct(F.col("topic").alias("display_name"))).alias("x_concepts"),
        F.array(F.struct(F.lit(2020).alias("year"), F.lit(3).alias("works_count")), F.struct("year", "works_count")).alias("counts_by_year"),
    ).alias("candidate"))
    return people, resolve.merge_candidates(found)


# of names whose last words differ "zzz qq" shares nothing with the other but a space
_DECISION = f"""{cte("author_records")},
once AS (SELECT *, row_number() OVER (PARTITION BY professor_id, author_id ORDER BY variant, pos) AS nth FROM author_records),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY professor_id ORDER BY variant, pos) AS INT) AS place FROM once WHERE nth = 1),
s AS (SELECT m.professor_id, m.author_id AS candidate_id, display_name AS candidate_display_name, place AS pos,
  round(CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.89 WHEN 2 THEN 0.84 WHEN 3 THEN 0.97 ELSE 2.0 / (length(s_name) + 7 + 6) END, 4) AS name_score,
  CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.89 WHEN 2 THEN 0.84 WHEN 3 THEN 0.97 ELSE 2.0 / (length(s_name) + 7 + 6) END AS exact_name,
  CASE WHEN institution = 'I' || s_nationkey THEN 1.0 ELSE 0.0 END AS institution_score,
  CASE WHEN (s_suppkey % 4 = 2) = (topic = 'Cosmology') THEN 1.0 ELSE 0.0 END AS topic_score,
  CASE WHEN works_count = 0 OR year < 2021 THEN 0.1 WHEN year < 2023 THEN 0.4 WHEN year < 2025 THEN 0.7 ELSE 1.0 END AS recency_score
  FROM merged m JOIN supplier ON s_suppkey = professor_id WHERE place <= 5),
scored AS (SELECT *, round(0.55 * exact_name + 0.25 * institution_score + 0.1 * topic_score + 0.1 * recency_score, 4) AS score FROM s),
best AS (SELECT *, row_number() OVER w AS nth, lead(score, 1, 0.0) OVER w AS runner FROM scored WINDOW w AS (PARTITION BY professor_id ORDER BY score DESC, pos))
"""


@query(_DECISION + "SELECT professor_id, candidate_id, candidate_display_name, pos, CAST(name_score AS DOUBLE) AS name_score, CAST(institution_score AS DOUBLE) AS institution_score, CAST(topic_score AS DOUBLE) AS topic_score, CAST(recency_score AS DOUBLE) AS recency_score, CAST(score AS DOUBLE) AS score FROM scored")
def match_candidates_ranked(spark, d):
    people, found = _candidates(spark, d)
    return resolve.score_candidates(people, found).select("professor_id", "candidate_id", "candidate_display_name", "pos", "name_score", "institution_score", "topic_score", "recency_score", "score")


@query(_DECISION + """SELECT s_suppkey AS professor_id, coalesce(CAST(score AS DOUBLE), 0.0) AS match_score, coalesce(CAST(runner AS DOUBLE), 0.0) AS runner_up_score,
  CASE WHEN coalesce(score, 0) < 0.82 THEN 'unmatched' WHEN score - runner <= 0.05 THEN 'ambiguous' ELSE 'matched' END AS match_status,
  CASE WHEN score >= 0.82 AND score - runner > 0.05 THEN candidate_id END AS author_id,
  candidate_id AS selected_id, candidate_display_name AS selected_name FROM supplier LEFT JOIN best ON professor_id = s_suppkey AND nth = 1""")
def match_decision(spark, d):
    people, found = _candidates(spark, d)
    evidence = lambda path, name: F.get_json_object("evidence", f"$.selected.{path}").alias(name)
    return resolve.decide(people, resolve.score_candidates(people, found)).select("professor_id", "match_status", "match_score", "author_id", "runner_up_score", evidence("candidate_id", "selected_id"), evidence("candidate_display_name", "selected_name"))


@query("""WITH s AS (SELECT s_suppkey AS professor_id, round(CAST(1000 + (s_suppkey * 7919 + k * 104729) % 9000 AS DOUBLE) / 10000, 4) AS score, k AS pos
  FROM supplier, range(1, 4) r(k) WHERE s_suppkey % 9 > 0),
r AS (SELECT *, row_number() OVER w AS nth, lead(score, 1, 0.0) OVER w AS runner FROM s WINDOW w AS (PARTITION BY professor_id ORDER BY score DESC, pos))
SELECT s_suppkey AS professor_id, coalesce(score, 0.0) AS match_score, coalesce(runner, 0.0) AS runner_up_score,
  CASE WHEN coalesce(score, 0) < 0.82 THEN 'unmatched' WHEN score - runner <= 0.05 THEN 'ambiguous' ELSE 'matched' END AS match_status,
  CASE WHEN score >= 0.82 AND score - runner > 0.05 THEN 'C' || pos END AS author_id
FROM supplier LEFT JOIN r ON professor_id = s_suppkey AND nth = 1""")
def match_thresholds(spark, d):
    people = view(spark, d, "supplier").select(F.col("s_suppkey").alias("professor_id"))
    k = people.where("professor_id % 9 > 0").withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(3))))
    score = F.round((1000 + (F.col("professor_id") * 7919 + F.col("pos") * 104729) % 9000).cast("double") / 10000, 4)
    none = F.lit(None)
    scored = k.select("professor_id", "pos", score.alias("score"), F.concat(F.lit("C"), F.col("pos").cast("string")).alias("candidate_id"), none.cast("string").alias("candidate_display_name"), *[none.cast("double").alias(c) for c in ("institution_score", "name_score", "recency_score", "topic_score")])
    return resolve.decide(people, scored).select("professor_id", "match_score", "runner_up_score", "match_status", "author_id")


# -- works


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def abstract_reconstruct(spark, d):
    rows = view(spark, d, "documents").select("doc_id", F.posexplode(F.split(text.normalize_whitespace(F.col("text")), " ")).alias("pos", "word")).where("word != ''")
    index = rows.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", works.reconstruct_abstract(F.col("index")).alias("abstract"))


@query("""SELECT conv_id, coalesce(max(CASE WHEN role = 'assistant' AND nth = 1 THEN 'turn' || turn END), 'unknown') AS position,
  bool_or(CASE WHEN role = 'assistant' AND nth = 1 THEN turn > 1 END) AS is_corresponding
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations) GROUP BY conv_id""")
def authorship_position(spark, d):
    a = F.struct(F.col("turn"), F.struct(F.col("role").alias("id")).alias("author"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("author_position"), (F.col("turn") > 1).alias("is_corresponding"))
    rows = view(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(a)).alias("authorships"))
    found = works.authorship(F.col("authorships"), F.lit("assistant"))
    return rows.select("conv_id", found["position"].alias("position"), found["is_corresponding"].alias("is_corresponding"))


@query(f"{cte('works')} SELECT work_id, lang || ' topic' AS names FROM works JOIN documents ON doc_id = work_id")
def topics_names(spark, d):
    return view(spark, d, "works").select("work_id", works.topic_names(F.col("topics_json")).alias("names"))


# whole tables; a third of the stored rows are moved to ids that nobody has
@query(f"{cte('people', 'matches', 'links')} SELECT professor_id, author_id FROM people JOIN matches USING (professor_id) WHERE match_status IN ('matched', 'manual_override') AND verification_status = 'verified' AND duplicate_of IS NULL AND professor_id NOT IN (SELECT CASE WHEN professor_id % 3 = 0 THEN -professor_id - 1 ELSE professor_id END FROM links)")
def needs_works(spark, d):
    stored = view(spark, d, "links").withColumn("professor_id", F.expr("CASE WHEN professor_id % 3 = 0 THEN -professor_id - 1 ELSE professor_id END"))
    return works.needs_works(view(spark, d, "people"), view(spark, d, "matches"), stored).select("professor_id", "author_id")


@query(f"{cte('works')} SELECT work_id FROM works LEFT JOIN (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, o_orderstatus, o_orderkey FROM orders) o ON k = work_id WHERE k IS NULL OR o_orderstatus <> 'F' OR o_orderkey % 5 = 0")
def needs_embedding(spark, d):
    stored = view(spark, d, "orders").select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END").alias("work_id"), F.col("o_orderstatus").alias("backend"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 32 ELSE 64 END").alias("dimension"))
    return works.needs_embedding(view(spark, d, "works"), stored, "F", 64).select("work_id")


@query(f"{cte('people', 'matches')} SELECT professor_id FROM people LEFT JOIN matches USING (professor_id) WHERE match_status IS NULL OR match_status IN ('unmatched', 'ambiguous') OR (match_status = 'matched' AND author_id IS NULL)")
def needs_matching(spark, d):
    return resolve.needs_matching(view(spark, d, "people"), view(spark, d, "matches")).select("professor_id")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'signup')")
def needs_scrape(spark, d):
    status = F.expr("CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'pending' ELSE 'scraped' END")
    return seed.needs_scrape(view(spark, d, "events").withColumn("status", status)).select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 250")
def checkpoint_resume(spark, d):
    return works.resume(view(spark, d, "events").select("event_id", "event_type"), "event_id", 700, 250)


# -- audit


def _audit_tables(spark, d):
    return [view(spark, d, n) for n in ("people", "universities", "matches", "works", "links")]


def _hit(departments: str, blob: str) -> str:
    return "(" + " OR ".join(f"(list_contains({departments}, '{k}') AND (" + " OR ".join(f"contains({blob}, '{w}')" for w in ws) + "))" for k, ws in AUDIT_WORDS.items()) + ")"


def sql_terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    words = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z0-9-]{{2,}}')"
    singular = f"list_transform({words}, lambda w: CASE WHEN length(w) > 5 AND ends_with(w, 'ies') THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 5 AND ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END)"
    return f"list_filter({singular}, lambda w: length(w) >= 4 AND w NOT IN ({stop}))"


_BLOB = "array_to_string(list_filter([lower(title), lower(abstract), lower(source_name), lang || ' topic'], lambda x: x <> ''), ' ')"
_AUDIT = f"""{cte("universities", "people", "matches", "works", "links")},
cohort AS (SELECT p.* FROM people p JOIN matches m USING (professor_id) WHERE verification_status = 'verified' AND duplicate_of IS NULL AND match_status = 'matched'),
rows AS (SELECT coalesce(duplicate_of, professor_id) AS owner, * FROM people WHERE coalesce(duplicate_of, professor_id) IN (SELECT professor_id FROM cohort)),
departments AS (SELECT owner, list(DISTINCT department_type) AS departments FROM rows GROUP BY owner),
seed AS (SELECT owner, professor_id, {sql_terms("array_to_string(list_filter([title, source_snippet, profile_text], lambda x: x <> ''), ' ')")} AS words FROM rows),
spots AS (SELECT owner, professor_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM seed),
counted AS (SELECT owner, term, count(*) AS n, min(professor_id * 100000 + pos) AS first FROM spots GROUP BY ALL),
terms AS (SELECT owner, list(term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, first) AS r FROM counted) WHERE r <= 18 GROUP BY owner),
blobs AS (SELECT l.professor_id AS owner, w.*, {_BLOB} AS blob, coalesce(terms, []) AS terms, departments FROM links l JOIN departments d ON d.owner = l.professor_id LEFT JOIN terms t ON t.owner = l.professor_id
  JOIN works w USING (work_id) JOIN documents ON doc_id = work_id),
theirs AS (SELECT *, {_hit("departments", "blob")} AS hit, list_intersect(terms, {sql_terms("blob")}) AS overlap FROM blobs),
sums AS (SELECT owner, count(*) AS total_works, avg(hit::INT) AS keyword_share, avg((trim(regexp_replace(abstract, '\\s+', ' ', 'g')) <> '')::INT) AS abstract_share,
  avg(coalesce(lower(source_name) LIKE 'arxiv%', false)::INT) AS arxiv_share, count(DISTINCT source_name) AS distinct_source_count,
  avg((len(overlap) > 0)::INT) AS work_share, max(len(terms)) AS n_terms,
  array_to_string((list(title ORDER BY work_id) FILTER (NOT hit AND title <> ''))[1:5], '|') AS off FROM theirs GROUP BY owner HAVING count(*) >= 5),
seen AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, term) AS r FROM (SELECT owner, term, count(*) AS n FROM (SELECT owner, unnest(overlap) AS term FROM theirs) GROUP BY owner, term)),
shown AS (SELECT owner, count(*) AS covered, array_to_string(list(term ORDER BY r) FILTER (r <= 6), '|') AS shown FROM seen GROUP BY owner),
found AS (SELECT s.*, CASE WHEN n_terms > 0 THEN round(greatest(coalesce(covered, 0) / n_terms, work_share), 4) END AS aligned, coalesce(shown, '') AS shown FROM sums s LEFT JOIN shown USING (owner)),
rules AS (SELECT *, coalesce(aligned, keyword_share) AS base,
  coalesce(total_works >= 20 AND aligned < 0.22, false) AS r1, coalesce(total_works >= 20 AND keyword_share < 0.55 AND (aligned IS NULL OR aligned < 0.35), false) AS r2,
  total_works >= 20 AND abstract_share < 0.55 AS r3, distinct_source_count >= 35 AND coalesce(aligned, keyword_share) < 0.7 AS r4, total_works >= 20 AND arxiv_share > 0.85 AS r5 FROM found),
final AS (SELECT *, round(1.0 - base + CASE WHEN r1 THEN 0.45 ELSE 0 END + CASE WHEN r2 THEN CASE WHEN aligned IS NOT NULL THEN 0.25 ELSE 0.35 END ELSE 0 END + CASE WHEN r3 THEN 0.15 ELSE 0 END
  + CASE WHEN r4 THEN 0.15 ELSE 0 END + CASE WHEN r5 THEN 0.05 ELSE 0 END, 4) AS suspicious_score,
  array_to_string(list_filter([CASE WHEN r1 THEN 'low_profile_alignment' END, CASE WHEN r2 THEN 'low_department_alignment' END, CASE WHEN r3 THEN 'low_abstract_coverage' END,
  CASE WHEN r4 THEN 'high_venue_diversity' END, CASE WHEN r5 THEN 'mostly_arxiv' END], lambda x: x IS NOT NULL), '|') AS reasons FROM rules)
"""


def _ratios(spark, d):
    people, universities, matches, w, links = _audit_tables(spark, d)
    cohort = search.searchable(people).join(matches.where("match_status = 'matched'"), "professor_id", "left_semi")
    return audit.ratios(cohort, people, w, links, min_works=5)


@query(_AUDIT + """SELECT owner AS professor_id, total_works, round(keyword_share, 6) AS keyword_share, round(abstract_share, 6) AS abstract_share,
  round(arxiv_share, 6) AS arxiv_share, distinct_source_count, aligned AS profile_alignment_ratio FROM found""")
def audit_ratios(spark, d):
    share = [F.round(c, 6).alias(c) for c in ("keyword_share", "abstract_share", "arxiv_share")]
    return _ratios(spark, d).select("professor_id", "total_works", *share, "distinct_source_count", "profile_alignment_ratio")


@query(_AUDIT + "SELECT owner AS professor_id, shown AS profile_terms, coalesce(off, '') AS off_topic FROM found")
def audit_profile_terms(spark, d):
    return _ratios(spark, d).select("professor_id", joined(F.col("profile_terms")).alias("profile_terms"), joined(F.col("sample_off_topic_titles")).alias("off_topic"))


@query(_AUDIT + """SELECT owner AS professor_id, p.name AS professor_name, u.name AS university_name, p.department_type, total_works, round(keyword_share, 4) AS keyword_hit_ratio,
  aligned AS profile_alignment_ratio, suspicious_score, reasons FROM final JOIN people p ON p.professor_id = owner JOIN universities u USING (university_id)
  WHERE reasons <> '' ORDER BY suspicious_score DESC, total_works DESC, owner LIMIT 25""")
def audit_suspicious(spark, d):
    out = audit.audit_publications(*_audit_tables(spark, d), min_works=5, limit=25)
    return out.select("professor_id", "professor_name", "university_name", "department_type", "total_works", "keyword_hit_ratio", "profile_alignment_ratio", "suspicious_score", joined(F.col("reasons")).alias("reasons"))


# -- views of the store


@query(f"""{cte("people", "matches", "works")} SELECT 'verified_professors' AS name, count(*) AS count FROM people WHERE verification_status = 'verified' AND duplicate_of IS NULL
UNION ALL SELECT 'duplicate_professors', count(*) FROM people WHERE duplicate_of IS NOT NULL
UNION ALL SELECT 'matched_authors', count(*) FROM matches WHERE match_status IN ('matched', 'manual_override')
UNION ALL SELECT 'ambiguous_matches', count(*) FROM matches WHERE match_status = 'ambiguous'
UNION ALL SELECT 'unmatched_authors', count(*) FROM matches WHERE match_status = 'unmatched'
UNION ALL SELECT 'works', count(*) FROM works UNION ALL SELECT 'candidates', count(*) FROM part UNION ALL SELECT 'embedded_works', count(*) FROM embeddings""")
def status_counts(spark, d):
    return inspect.status_counts(*[view(spark, d, n) for n in ("people", "matches", "works", "part", "embeddings")])


@query(f"{cte('people')} SELECT DISTINCT department_type FROM people ORDER BY 1")
def distinct_departments(spark, d):
    return inspect.department_types(view(spark, d, "people"))


@query(f"{cte('works', 'links')} SELECT * FROM (SELECT professor_id, work_id, publication_year, CAST(row_number() OVER (PARTITION BY professor_id ORDER BY publication_year DESC NULLS LAST, cited_by_count DESC NULLS LAST, work_id DESC) AS INT) AS place FROM links JOIN works USING (work_id)) WHERE place <= 3")
def recent_works_top3(spark, d):
    return inspect.recent_works(view(spark, d, "links"), view(spark, d, "works"), 3, by="citations").select("professor_id", "work_id", "publication_year", "place")


@query(f"{cte('works', 'links')} SELECT * FROM (SELECT professor_id, work_id, title, CAST(row_number() OVER (PARTITION BY professor_id ORDER BY publication_year DESC NULLS LAST, work_id DESC) AS INT) AS place FROM links JOIN works USING (work_id)) WHERE place <= 8")
def person_detail_works(spark, d):
    return inspect.recent_works(view(spark, d, "links"), view(spark, d, "works"), 8).select("professor_id", "work_id", "title", "place")


@query(f"{cte('universities', 'people', 'matches')} SELECT p.professor_id, p.name, u.name AS university_name, match_status, CASE p.professor_id WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS place FROM people p JOIN universities u USING (university_id) LEFT JOIN matches USING (professor_id) WHERE p.professor_id IN (7, 3, 5) ORDER BY place")
def compare_people(spark, d):
    rows = inspect.compare(*[view(spark, d, n) for n in ("people", "universities", "matches")], inspect.parse_ids("7, 3,x,7,5"))
    return rows.select("professor_id", "name", "university_name", "match_status", "place")


@query(f"{cte('universities', 'people')} SELECT p.professor_id, p.name, p.duplicate_of, c.name AS canonical_name, u.name AS canonical_university FROM people p JOIN people c ON c.professor_id = p.duplicate_of JOIN universities u ON u.university_id = c.university_id")
def duplicate_lookup(spark, d):
    return inspect.duplicates_of(view(spark, d, "people"), view(spark, d, "universities")).select("professor_id", "name", "duplicate_of", "canonical_name", "canonical_university")


@query(f"{cte('universities', 'people', 'matches')} SELECT professor_id, p.name, u.name AS university_name, match_status, match_score FROM matches JOIN people p USING (professor_id) JOIN universities u USING (university_id) WHERE match_status IN ('ambiguous', 'unmatched')")
def review_queue(spark, d):
    return inspect.review_queue(*[view(spark, d, n) for n in ("people", "universities", "matches")])


@query("SELECT c_custkey AS professor_id, c_name AS name FROM customer WHERE c_name ILIKE '%r#0000001_3%'")
def ilike_lookup(spark, d):
    return inspect.by_name(view(spark, d, "customer").select(F.col("c_custkey").alias("professor_id"), F.col("c_name").alias("name")), "R#0000001_3")


@query(_found["ilike_lookup"][1])
def ilike_lookup_by_trigrams(spark, d):
    people = view(spark, d, "customer").select(F.col("c_custkey").alias("professor_id"), F.col("c_name").alias("name"))
    return inspect.by_name(people, "R#0000001_3", nameindex.write(people, scratch_path(spark, "postings")))


_PATTERNS = "SELECT DISTINCT lower(w) AS pattern FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM benchmark)"


@query(f"WITH patterns AS ({_PATTERNS}) SELECT doc_id, count(*) AS n, min(pattern) AS first, max(pattern) AS last FROM documents JOIN patterns ON contains(lower(text), pattern) GROUP BY doc_id")
def patterns_in_documents(spark, d):
    """Which words of the benchmark stand in a document, within words too."""
    words = view(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), 0)).alias("w")).select(F.lower("w").alias("pattern"))
    docs = view(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    found = patterns.pairs(docs, "doc_id", "text", words)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pattern").alias("first"), F.max("pattern").alias("last"))


@query(f"{cte('grants')} SELECT professor_id, round(coalesce(sum(amount), 0), 2) AS total_funding, count(*) AS grants, bool_or(coalesce(end_date >= '{TODAY}', false)) AS actively_funded FROM grants GROUP BY professor_id")
def funding_summary(spark, d):
    return funding.funding_summary(view(spark, d, "grants"), TODAY).withColumn("total_funding", F.round("total_funding", 2))


def _payloads(spark, d):
    o = view(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    nih = o.where("o_orderkey % 2 = 0").select(key.alias("project_num"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("S"), key)).alias("applied_serial_num"), F.col("o_orderpriority").alias("project_title"), F.when(F.col("o_orderkey") % 6 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("award_amount"), F.lit(7.5).alias("award_amount_per_year"), F.col("o_orderdate").cast("string").alias("project_start_date"), F.lit("").alias("project_end_date"), F.array(F.struct(F.col("o_orderstatus").alias("full_name"))).alias("principal_investigators"))
    nsf = o.where("o_orderkey % 2 = 1").select(key.alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("fundsObligatedAmt"), F.lit(None).cast("double").alias("funds"), F.concat(F.lit('{"date":"'), F.col("o_orderdate").cast("string"), F.lit('"}')).alias("startDate"), F.col("o_orderdate").cast("string").alias("expDate"), F.lit("Ann").alias("piFirstName"), F.col("o_orderstatus").alias("piLastName"))
    return nih, nsf


_DAY = "substr(CAST(o_orderdate AS VARCHAR), 1, 10)"
_NIH_SQL = f"SELECT 'nih' AS source, CASE WHEN o_orderkey % 4 = 0 THEN 'S' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS grant_id, o_orderpriority AS title, o_orderstatus AS pi_name, CASE WHEN o_orderkey % 6 = 0 THEN 7.5 ELSE o_totalprice END AS amount, {_DAY} AS start_date, CAST(NULL AS VARCHAR) AS end_date FROM orders WHERE o_orderkey % 2 = 0"
_NSF_SQL = f"SELECT 'nsf', CAST(o_orderkey AS VARCHAR), o_orderpriority, 'Ann ' || o_orderstatus, o_totalprice, {_DAY}, {_DAY} FROM orders WHERE o_orderkey % 2 = 1"


@query(_NIH_SQL)
def grant_parse(spark, d):
    return funding.parse_nih(_payloads(spark, d)[0])


@query(f"{_NIH_SQL} UNION ALL {_NSF_SQL}")
def grants_union(spark, d):
    nih, nsf = _payloads(spark, d)
    return funding.grants(funding.parse_nih(nih), funding.parse_nsf(nsf))


# -- evaluation


_EXPECTED = """SELECT item_id AS query_id, text AS query, ['0000000' || (item_id % 20), 'nobody'] AS people, CASE WHEN item_id % 3 = 0 THEN ['nation_' || (item_id % 25)] ELSE [] END AS places,
  CASE WHEN item_id % 4 = 0 THEN 0 END AS least FROM benchmark WHERE item_id % 5 > 0"""


def _expected(spark, d):
    item = F.col("item_id")
    none = F.array().cast("array<string>")
    rows = view(spark, d, "benchmark")
    some = item % 5 > 0
    return rows.select(item.alias("query_id"), F.col("text").alias("query"), F.lit("").alias("notes"), F.when(some, F.array(F.concat(F.lit("0000000"), (item % 20).cast("string")), F.lit("nobody"))).otherwise(none).alias("expected_professors"), F.when(some & (item % 3 == 0), F.array(F.concat(F.lit("nation_"), (item % 25).cast("string")))).otherwise(none).alias("expected_universities"), F.when(item % 4 == 0, 0).alias("minimum_professor_matches"), F.lit(None).cast("int").alias("minimum_university_matches"))


def _evaluated(spark, d):
    return evaluate.evaluate(_expected(spark, d), _search(spark, d, batch=True, limit=10)[0])


_EVALUATED = f"""{sql_search(MANY_QUERIES)}{HITS}, top AS (SELECT query_id, list(lower(professor_name)) AS ps, list(lower(university_name)) AS us FROM hits WHERE rank <= 10 GROUP BY query_id),
expected AS (SELECT item_id AS query_id, item_id % 5 > 0 AS labelled, CASE WHEN item_id % 5 > 0 THEN ['0000000' || (item_id % 20), 'nobody'] ELSE [] END AS people,
  CASE WHEN item_id % 5 > 0 AND item_id % 3 = 0 THEN ['nation_' || (item_id % 25)] ELSE [] END AS places, CASE WHEN item_id % 4 = 0 THEN 0 END AS least FROM benchmark),
matched AS (SELECT *, list_filter(people, lambda p: len(list_filter(ps, lambda v: contains(v, p))) > 0) AS mp, list_filter(places, lambda p: len(list_filter(us, lambda v: contains(v, p))) > 0) AS mu FROM expected JOIN top USING (query_id)),
results AS (SELECT query_id, array_to_string(mp, '|') AS matched_professors, array_to_string(mu, '|') AS matched_universities,
  CASE WHEN labelled THEN len(mp) >= coalesce(least, CASE WHEN len(people) > 0 THEN 1 ELSE 0 END) AND len(mu) >= CASE WHEN len(places) > 0 THEN 1 ELSE 0 END END AS hit_at_k FROM matched)"""


@query(_EVALUATED + " SELECT * FROM results")
def evaluate_hit_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", joined(F.col("matched_professors")).alias("matched_professors"), joined(F.col("matched_universities")).alias("matched_universities"), "hit_at_k")


@query(_EVALUATED + """ SELECT count(*) AS total_queries, count(hit_at_k) AS labeled_queries, count(*) FILTER (hit_at_k) AS queries_with_expected_hits,
  count(hit_at_k) - count(*) FILTER (hit_at_k) AS queries_with_expected_misses, round(count(*) FILTER (hit_at_k) / count(hit_at_k), 4) AS expected_hit_rate FROM results""")
def evaluation_summary(spark, d):
    return evaluate.summarize(_evaluated(spark, d))


# -- SQL alone


def _sql(spark, d, text, *names):
    sqlfun.register(spark)
    return spark.sql(text, **{n: view(spark, d, n) for n in names})


@query(f"{cte('people')} SELECT CASE WHEN contains(lower(title), 'professor') THEN 'verified' ELSE 'ambiguous' END AS status, count(*) AS n FROM people GROUP BY 1")
def sql_title_status(spark, d):
    return _sql(spark, d, "SELECT title_status(title) AS status, count(*) AS n FROM {people} GROUP BY 1", "people")


@query(f"""{cte("works")}, t AS (SELECT work_id, {sql_tokens("title")} AS tt, {sql_tokens("abstract")} AS ta, {sql_tokens(sql_normal_query(chr(39) + QUERY + chr(39)))} AS q FROM works)
SELECT work_id, round(0.2 * ({sql_keyword("q", "tt")}) + 0.1 * ({sql_keyword("q", "ta")}) + 0.05 * greatest({sql_phrase("q", "tt")}, 0.5 * ({sql_phrase("q", "ta")})), 6) AS score FROM t""")
def sql_work_score(spark, d):
    asked = text.normalize_query(F.lit(QUERY))
    words = spark.range(1).select(asked.alias("q")).first()[0]
    return _sql(spark, d, f"SELECT work_id, round(work_score(0D, search_terms('{words}'), search_terms(title), search_terms(abstract)), 6) AS score FROM {{works}}", "works")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT v.label, round(sum(list_cosine_similarity(v.e, q.e)), 4) AS likeness, count(*) AS n FROM v, v q WHERE q.vec_id = 0 GROUP BY v.label""")
def sql_cosine_by_label(spark, d):
    return _sql(spark, d, "SELECT label, round(sum(cosine_of(CAST(embedding AS ARRAY<DOUBLE>), (SELECT CAST(first(embedding) AS ARRAY<DOUBLE>) FROM {embeddings} WHERE vec_id = 0))), 4) AS likeness, count(*) AS n FROM {embeddings} GROUP BY label", "embeddings")


@query(f"{cte('grants')} SELECT professor_id, round(sum(amount), 2) AS active FROM grants WHERE coalesce(end_date >= '{TODAY}', false) GROUP BY professor_id")
def sql_active_funding(spark, d):
    return _sql(spark, d, f"SELECT professor_id, round(sum(amount), 2) AS active FROM {{grants}} WHERE active_grant(end_date, '{TODAY}') GROUP BY professor_id", "grants")


# -- changes


@query("""WITH new AS (SELECT o_custkey AS c_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(status, 'old') AS status FROM customer LEFT JOIN new USING (c_custkey)""")
def upsert_latest_wins(spark, d):
    old = view(spark, d, "customer").select("c_custkey", "c_name", F.lit("old").alias("status"))
    new = view(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    new = new.join(old.select("c_custkey"), "c_custkey", "left_semi")
    return store.upsert(old, store.latest(new, ["c_custkey"], "seq"), ["c_custkey"], keep=["c_name"])


@query(f"{cte('matches', 'links')} SELECT l.* FROM links l LEFT JOIN (SELECT professor_id FROM matches WHERE match_status = 'unmatched') m USING (professor_id) WHERE m.professor_id IS NULL")
def resolve_delete_links(spark, d):
    gone = view(spark, d, "matches").where("match_status = 'unmatched'")
    return store.delete(view(spark, d, "links"), gone, ["professor_id"])


@query("""WITH entries AS (SELECT l_orderkey % 40 AS source_id, 'u' || l_partkey AS url, min('n' || (l_suppkey % 70)) AS nm FROM lineitem GROUP BY ALL),
old AS (SELECT p_partkey AS id, p_partkey % 40 AS source_id, 'u' || p_partkey AS url, 'n' || (p_partkey % 70) AS nm FROM part),
byurl AS (SELECT source_id, url, min(id) AS id FROM old GROUP BY ALL), byname AS (SELECT source_id, nm, min(id) AS id FROM old GROUP BY ALL)
SELECT e.source_id, e.url, e.nm, coalesce(b.id, n.id) AS id FROM entries e LEFT JOIN byurl b USING (source_id, url) LEFT JOIN byname n ON n.source_id = e.source_id AND n.nm = e.nm""")
def upsert_two_keys(spark, d):
    new = view(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("source_id"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.concat(F.lit("n"), (F.col("l_suppkey") % 70).cast("string")).alias("nm"))
    entries = new.groupBy("source_id", "url").agg(F.min("nm").alias("nm"))
    old = view(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("source_id"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("n"), (F.col("p_partkey") % 70).cast("string")).alias("nm"))
    return store.target_ids(entries, old, "id", ["source_id", "url"], ["source_id", "nm"]).select("source_id", "url", "nm", "id")


@query("""SELECT c.c_custkey AS id, coalesce(o.last, -1) AS last, coalesce(o.status, 'none') AS status FROM customer c
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def upsert_in_a_store(spark, d):
    """Last orders merged into a stored table of customers, as deltas by key."""
    s = store.Store(spark, scratch_path(spark, "store"))
    s.write("customers", view(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("bigint").alias("last"), F.lit("none").alias("status")), key=["id"])
    rows = view(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("bigint").alias("last"), F.col("o_orderstatus").alias("status"))
    known = s.read("customers").select("id")
    for k in (1, 2):  # the second changes rows of the first where its orders are later
        part = rows.where(F.col("last") % 3 == k).join(known, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("last", "status"), "last").alias("r")).select("id", "r.*")
        before = s.read("customers").select("id", F.col("last").alias("had"))
        s.merge("customers", part.join(before, "id").where(F.col("last") > F.col("had")).drop("had"), ["id"])
    return s.read("customers")


@query("""SELECT id, seq FROM (SELECT 'W' || (o_custkey % 50) AS id, max(o_orderkey) AS seq FROM orders WHERE o_orderkey % 7 > 0 GROUP BY 1)""")
def stream_latest(spark, d):
    """Payload files read as a stream, late ones after newer: what its state lets pass is
    merged, and ends as the last of each key."""
    folder, s = scratch_path(spark, "payloads"), store.Store(spark, scratch_path(spark, "store"))
    line = F.to_json(F.struct(F.concat(F.lit("W"), (F.col("o_custkey") % 50).cast("string")).alias("id"), F.col("o_orderkey").cast("bigint").alias("seq")))
    rows = view(spark, d, "orders").where("o_orderkey % 7 > 0")
    # files in an order that has nothing to do with seq
    rows.repartition(3, F.xxhash64("o_orderkey")).select(line.alias("value")).write.text(folder)

    def batch(found, number):
        told = found.where("new_work").select(F.from_json("payload", "id string, seq bigint").alias("p")).select("p.*")
        s.merge("latest", cut(told), ["id"])

    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(folder)
    last_words(lines).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", scratch_path(spark, "seen")).trigger(availableNow=True).start().awaitTermination()
    return s.read("latest")


# -- pages


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '(^|\\.)example\\.(com|org)$') AS allowed FROM pages")
def domain_allowlist(spark, d):
    domains = F.array(F.lit("example.com"), F.lit("example.org"))
    return view(spark, d, "pages").select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), text.host_allowed(F.col("url"), domains).alias("allowed"))


def _site(spark, d):
    """A roster page for each nation, with its suppliers, in one of three layouts."""
    person = F.concat(F.lit("Ann "), F.col("s_name"))
    link = F.concat(F.lit('<a class="faculty-name" href="/p/'), F.col("s_suppkey").cast("string"), F.lit('">'), person, F.lit("</a>"))
    mail = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("@Example.org"))
    kind = F.col("s_nationkey") % 3
    card = F.when(kind == 0, F.concat(F.lit('<div class="card faculty-card"><h3>'), link, F.lit('</h3><p class="faculty-card__job-title">Professor &amp;\n Chair</p>'), mail, F.lit("</div>")))
    card = card.when(kind == 1, F.concat(F.lit('<div class="views-row"><h3>'), link, F.lit('</h3><p class="title"><b class="title">Professor &amp; Chair</b></p><div class="email"><a>'), mail, F.lit("</a></div></div>")))
    card = card.otherwise(F.concat(F.lit('<div class="faculty-member">'), link, F.lit('<p class="position-title">Position title: Professor &amp; Chair'), F.lit("</p>"), mail, F.lit("</div>")))
    pages = view(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", card.alias("card")))), lambda c: c["card"]), "").alias("cards"), F.count("*").alias("n"))
    more = F.concat(F.lit('<a href="?page='), F.col("n").cast("string"), F.lit('#top">next</a><a href="/other?page=1">x</a><a href="?page='), F.col("n").cast("string"), F.lit('">again</a>'))
    url = F.concat(F.lit("https://example.org/n/"), F.col("page_id").cast("string"))
    hint = F.when(F.col("page_id") % 3 == 0, "mit_faculty_cards").when(F.col("page_id") % 3 == 1, "penn_people_rows").otherwise("wisc_faculty_cards")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), F.concat(F.lit("<html><body>"), "cards", more).alias("html"), hint.alias("parser_hint"))


@query("SELECT CAST(s_nationkey AS BIGINT) AS page_id, 'https://example.org/n/' || s_nationkey || '?page=' || count(*) AS url FROM supplier GROUP BY s_nationkey")
def pagination_urls(spark, d):
    return page_source.pagination(_site(spark, d)).select("page_id", "url")


@query("""SELECT CAST(s_nationkey AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS position, 'Ann ' || s_name AS name,
  lower('Ann ' || replace(s_name, '#', '')) AS normalized_name, 'Professor & Chair' AS title, lower('s' || s_suppkey || '@example.org') AS email, 'https://example.org/p/' || s_suppkey AS profile_url FROM supplier""")
def roster_extract(spark, d):
    return page_source.rosters(_site(spark, d)).select("page_id", "position", "name", "normalized_name", "title", "email", "profile_url")


@query()
def profile_details(spark, d):
    return page_source.profiles(view(spark, d, "pages").select("page_id", "url", "html"))


from . import catalogue_sources  # noqa: E402, F401  registers its queries
