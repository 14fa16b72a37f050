"""Queries of sources, changes and files, and the SQL that must give the same rows.

Remote sources are asked through ``Service``, which makes its answers up from what it is
asked, so that the SQL can tell them too.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from ..functions import names, text, vectors
from ..operators import evaluate, funding, outreach, resolve, works
from ..scratch import shared_dir
from ..sources import fetch, pages, seed
from . import export, pipeline, store
from .catalogue import _TITLES, TODAY, _case, query
from .views import cte, view


class Service:
    """Answers for the queries below.  ``base`` tells which service is asked."""

    def get(self, url, params=None, body=None):
        where, asked = urlparse(url), params or {}
        find = getattr(self, {"people": "_people", "authors": "_authors", "works": "_works", "projects": "_projects", "awards.json": "_awards"}.get(where.path.split("/")[1], "_none"))
        found = find(where, asked, body)
        return (404, url, "") if found is None else (200, url, found if isinstance(found, str) else json.dumps(found))

    def _none(self, where, asked, body):
        return None

    def _people(self, where, asked, body):
        """/people/k: two pages of persons k.1, k.2 and k.2, k.3; /people/k/j: a profile
        with title and address, but none for j = 3; nothing for k divisible by 7."""
        k, *rest = where.path.split("/")[2:]
        if int(k) % 7 == 0:
            return None
        if rest:
            j = int(rest[0])
            return f"<p class=person-title>Professor {j} of {k}</p><p>P{k}.{j}@example.org</p>" if j < 3 else "<p>moved</p>"
        page = int(parse_qs(where.query).get("page", ["0"])[0])
        cards = "".join(f'<div class="person"><a href="/people/{k}/{j}">Ann{j} Lee{k}</a><p>Professor</p></div>' for j in ((1, 2), (2, 3))[page])
        return f'<html><body>{cards}<a href="?page=1">more</a><a href="/elsewhere?page=4">other</a></body></html>'

    def _authors(self, where, asked, body):
        """As many authors as the name has words, but no more than asked for."""
        n = min(len(asked["search"].split()), asked["per-page"])
        return {"results": [{"id": f"A{i}", "display_name": asked["search"]} for i in range(n)]}

    def _works(self, where, asked, body):
        """Author k has k % 8 works."""
        k, size = int(asked["filter"].split(",")[0].split(":A")[1]), asked["per-page"]
        count = k % 8
        lo = (asked["page"] - 1) * size
        return {"results": [{"id": f"W{k}.{i}", "title": asked["filter"].rsplit(":", 1)[1]} for i in range(lo, min(count, lo + size))], "meta": {"count": count}}

    def _projects(self, where, asked, body):
        """As many projects as the name has letters in its last word."""
        count, lo = len(body["criteria"]["pi_names"][0]["any_name"].split()[-1]), body["offset"]
        where_ = (body["criteria"].get("org_names") or [""])[0]
        return {"results": [{"project_num": f"{where_}-{i}"} for i in range(lo, min(count, lo + body["limit"]))]}

    def _awards(self, where, asked, body):
        count, lo = len(asked["piLastName"]), asked["offset"] - 1
        return {"response": {"award": [{"id": f"{asked.get('awardeeName', '')}-{asked['piLastName']}-{i}"} for i in range(lo, min(count, lo + asked["rpp"]))]}}


BASE = "https://service.example.org"


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/rosterlake-{name}-{uuid.uuid4().hex}"


# -- sources


_SEED = """SELECT n_nationkey AS pos, n_name AS name, 'n' || n_nationkey || '.example.edu' AS domain, CASE WHEN n_regionkey > 0 THEN 100 + n_nationkey END AS rank, n_regionkey, n_nationkey FROM nation"""


def _seed_file(spark, d) -> str:
    """Seed files of all nations, written by several tasks: as many departments as their
    region's number; one of region 4 is elsewhere."""
    path = _scratch(spark, "seed")
    site = F.concat(F.lit("https://www.n"), F.col("n_nationkey").cast("string"), F.lit(".example.edu/"))
    page = lambda k: F.when((F.col("n_regionkey") == 4) & (k == 4), F.lit("https://elsewhere.example.com/x")).otherwise(F.concat(site, k.cast("string")))
    departments = F.when(F.col("n_regionkey") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_regionkey"), F.lit(1)).cast("int")), lambda k: F.struct(F.concat(F.lit("d"), k.cast("string")).alias("department_type"), page(k).alias("roster_url"), F.concat(F.lit("h"), (k % 2).cast("string")).alias("parser_hint"))))
    rows = view(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("pos"), F.col("n_name").alias("name"), F.expr("CASE WHEN n_regionkey > 0 THEN CAST(100 + n_nationkey AS INT) END").alias("qs_rank_2026"), F.expr("'n' || n_nationkey || '.example.edu'").alias("domain"), departments.alias("departments"))
    rows.repartition(4, "name").write.json(path)
    return path


@query(f"SELECT CAST(pos AS INT) AS pos, name, domain, CAST(rank AS INT) AS qs_rank_2026, CAST(n_regionkey AS INT) AS departments FROM ({_SEED})")
def seed_scan(spark, d):
    items = seed.read_seed(spark, _seed_file(spark, d))
    return items.select("pos", "name", "domain", "qs_rank_2026", F.coalesce(F.size("departments"), F.lit(0)).alias("departments"))


_SOURCES = f"""SELECT name AS university, 'd' || k AS department_type, CASE WHEN n_regionkey = 4 AND k = 4 THEN 'https://elsewhere.example.com/x' ELSE 'https://www.n' || n_nationkey || '.example.edu/' || k END AS roster_url,
  'h' || (k % 2) AS parser_hint FROM ({_SEED}), range(1, 5) r(k) WHERE k <= n_regionkey"""


@query(f"SELECT * FROM ({_SOURCES}) WHERE roster_url LIKE '%elsewhere%'")
def seed_off_domain(spark, d):
    return seed.off_domain(seed.sources(seed.read_seed(spark, _seed_file(spark, d)))).drop("domain")


@query(f"{cte('universities')} SELECT university_id, s.* FROM ({_SOURCES}) s JOIN universities u ON u.name = s.university")
def sources_of_universities(spark, d):
    found = seed.sources(seed.read_seed(spark, _seed_file(spark, d))).drop("domain")
    return seed.placed(found, view(spark, d, "universities")).select("university_id", "university", "department_type", "roster_url", "parser_hint")


@query(f"""WITH old AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'old ' || n_name END AS name, 7 AS rank, 'completed' AS status FROM nation), new AS ({_SEED})
SELECT coalesce(n.name, o.name) AS name, CAST(CASE WHEN n.name IS NOT NULL THEN n.rank ELSE o.rank END AS INT) AS qs_rank_2026, CASE WHEN o.name IS NULL OR n.n_regionkey = 1 THEN 'pending' ELSE o.status END AS status
FROM old o FULL JOIN new n USING (name)""")
def university_upsert(spark, d):
    items = seed.read_seed(spark, _seed_file(spark, d))
    old = view(spark, d, "nation").select(F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'old ' || n_name END").alias("name"), *[F.lit(7 if c == "qs_rank_2026" else None).cast(t).alias(c) for c, t in (("short_name", "string"), ("qs_rank_2026", "int"), ("qs_score", "double"), ("domain", "string"), ("openalex_id", "string"), ("ror_id", "string"), ("state", "string"))], F.lit("completed").alias("status"))
    changed = view(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"))
    return seed.merge_universities(old, items, changed).select("name", "qs_rank_2026", "status")


@query(f"""WITH new AS (SELECT * FROM ({_SOURCES})), old AS (SELECT university, department_type, CASE WHEN department_type = 'd3' THEN roster_url || '/old' ELSE roster_url END AS roster_url, CASE WHEN department_type = 'd2' THEN 'other' ELSE parser_hint END AS parser_hint FROM new)
SELECT coalesce(n.university, o.university) AS university, coalesce(n.department_type, o.department_type) AS department_type, coalesce(n.roster_url, o.roster_url) AS roster_url, coalesce(n.parser_hint, o.parser_hint) AS parser_hint,
  CASE WHEN n.university IS NOT NULL AND (o.university IS NULL OR n.parser_hint <> o.parser_hint) THEN 'pending' ELSE 'scraped' END AS status
FROM old o FULL JOIN new n ON o.university = n.university AND o.department_type = n.department_type AND o.roster_url = n.roster_url""")
def source_upsert(spark, d):
    new = seed.sources(seed.read_seed(spark, _seed_file(spark, d)))
    kind = F.col("department_type")
    old = new.drop("domain").withColumns({"roster_url": F.when(kind == "d3", F.concat("roster_url", F.lit("/old"))).otherwise(F.col("roster_url")), "parser_hint": F.when(kind == "d2", "other").otherwise(F.col("parser_hint")), "status": F.lit("scraped"), "error_message": F.lit(None).cast("string")})
    return seed.merge_sources(old, new)[0].drop("error_message")


@query(f"""SELECT n_nationkey AS source_id, CASE WHEN n_nationkey % 7 = 0 THEN '{BASE}/people/' || n_nationkey || ': 404' END AS error, CASE WHEN n_nationkey % 7 > 0 THEN j - 1 END AS position, CASE WHEN n_nationkey % 7 > 0 THEN 'Ann' || j || ' Lee' || n_nationkey END AS name,
  CASE WHEN n_nationkey % 7 > 0 THEN CASE WHEN j < 3 THEN 'Professor ' || j || ' of ' || n_nationkey ELSE 'Professor' END END AS title, CASE WHEN n_nationkey % 7 > 0 AND j < 3 THEN 'p' || n_nationkey || '.' || j || '@example.org' END AS email
FROM nation, range(1, 4) r(j) WHERE n_nationkey % 7 > 0 OR j = 1""")
def roster_crawl_and_profiles(spark, d):
    """Rosters over several pages, repeats, profile pages, and sources that fail."""
    rows = view(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("source_id"), F.concat(F.lit(f"{BASE}/people/"), F.col("n_nationkey").cast("string")).alias("roster_url"), F.lit(None).cast("string").alias("parser_hint"))
    got = fetch.fetch_each(rows, Service, pipeline._scrape, pipeline.SCRAPED)
    return got.select("source_id", "error", "position", "name", "title", "email")


@query("""SELECT s_suppkey AS professor_id, v - 1 AS variant, CAST(p AS INT) AS pos, 'A' || p AS author_id, CASE v WHEN 1 THEN 'Ann Bea ' || s_name ELSE 'Ann ' || s_name END AS display_name
FROM supplier, range(1, 3) r(v), range(0, 2) q(p) WHERE p < least(2, CASE v WHEN 1 THEN 3 ELSE 2 END)""")
def author_search(spark, d):
    """Each spelling of a name searched for, two authors at most."""
    asked = view(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("professor_id"), names.name_variants(F.concat(F.lit("Dr. Ann Bea "), F.col("s_name"))).alias("variants"))

    def read(f, row):
        for v, p, author in fetch.candidates(f, BASE, list(row["variants"]), 2):
            yield {"professor_id": row["professor_id"], "variant": v, "pos": p, "author_id": author["id"], "display_name": author["display_name"]}

    return fetch.fetch_each(asked, Service, read, "professor_id bigint, variant int, pos int, author_id string, display_name string")


@query("SELECT s_suppkey AS professor_id, 'W' || s_suppkey || '.' || i AS external_id, '2021-01-01' AS title FROM supplier, range(0, 6) r(i) WHERE i < s_suppkey % 8")
def author_works_paged(spark, d):
    """Pages of two works, three pages at most."""

    def read(f, row):
        for work in fetch.author_works(f, BASE, row["author_id"], 2021, 2, 3):
            yield {"professor_id": row["professor_id"], "external_id": work["id"], "title": work["title"]}

    asked = view(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("professor_id"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("author_id"))
    return fetch.fetch_each(asked, Service, read, "professor_id bigint, external_id string, title string")


def _asked(spark, d):
    return funding.to_look_up(view(spark, d, "people"), view(spark, d, "universities"))


@query(f"{cte('universities', 'people')} SELECT professor_id, u.name || '-' || i AS grant_id FROM people p JOIN universities u USING (university_id), range(0, 12) r(i) WHERE verification_status = 'verified' AND duplicate_of IS NULL AND i < length(p.name)")
def nih_projects_paged(spark, d):
    """Pages of four projects, three pages at most, asked for by name and institution."""

    def read(f, row):
        for item in fetch.nih_projects(f, BASE, row["name"], row["institution"], 4, 3):
            yield {"professor_id": row["professor_id"], "grant_id": item["project_num"]}

    return fetch.fetch_each(_asked(spark, d), Service, read, "professor_id bigint, grant_id string")


@query(f"{cte('universities', 'people')} SELECT professor_id, u.name || '-' || p.name || '-' || i AS grant_id FROM people p JOIN universities u USING (university_id), range(0, 10) r(i) WHERE verification_status = 'verified' AND duplicate_of IS NULL AND i < length(p.name)")
def nsf_awards_paged(spark, d):
    def read(f, row):
        for item in fetch.nsf_awards(f, BASE, row["name"], row["institution"], 5, 2):
            yield {"professor_id": row["professor_id"], "grant_id": item["id"]}

    return fetch.fetch_each(_asked(spark, d), Service, read, "professor_id bigint, grant_id string")


@query(f"{cte('universities', 'people')} SELECT professor_id, p.name, u.name AS institution FROM people p JOIN universities u USING (university_id) WHERE verification_status = 'verified' AND duplicate_of IS NULL")
def funding_to_look_up(spark, d):
    return _asked(spark, d)


# -- roster pages in every layout


_N, _L, _M, _T = "{n}", "{l}", "{m}", "Professor &amp; Chair"
#: A person in each layout; the last, without a hint, is read as a generic card.
_CARDS = {
    "mit_faculty_cards": f'<div class="card faculty-card"><h3><a href="{_L}">{_N}</a></h3><p class="faculty-card__job-title">{_T}</p>{_M}</div>',
    "mit_dmse_cards": f'<div class="faculty-teaser"><a href="{_L}"><span class="faculty-teaser__name">{_N}</span></a><div class="faculty-teaser__title">{_T}</div>{_M}</div>',
    "stanford_hb_cards": f'<div class="hb-card hb-vertical-card"><div class="hb-card__title"><a href="{_L}">{_N}</a></div><div>{_T}</div><p>{_M}</p></div>',
    "berkeley_people_table": f'<table><tr><td><a href="{_L}">{_N}</a></td><td>{_T}</td><td>Faculty</td><td>{_M}</td></tr></table>',
    "caltech_people_listing": f'<div class="person-listing__person-row"><a class="person-listing__person-row__wrapper-link" href="{_L}"><h2 class="person-listing__summary__title">{_N}</h2></a><div class="person-listing__summary__faculty-title">{_T}</div>{_M}</div>',
    "princeton_content_list": f'<div class="content-list-item"><span class="field--name-title"><a href="{_L}">{_N}</a></span><div class="field--name-field-ps-people-position"><div class="field__item">{_T}</div></div>{_M}</div>',
    "penn_people_rows": f'<div class="views-row"><h3><a href="{_L}">{_N}</a></h3><p class="title"><span class="title">{_T}</span></p><span class="email"><a>{_M}</a></span></div>',
    "ucla_faculty_table": f'<table><tr><td><h5>{_N}</h5><p>{_T}<br>Office 1</p><a href="mailto:{_M}">{_M}</a><a href="{_L}">Site</a></td></tr></table>',
    "umd_k2_faculty": f'<div class="catItemView groupPrimary"><h3 class="catItemTitle"><a href="{_L}">{_N}</a></h3><span class="catItemExtraFieldsLabel">Title:</span><span class="catItemExtraFieldsValue">{_T}</span><span class="catItemExtraFieldsLabel">E-mail:</span><span class="catItemExtraFieldsValue">{_M}</span></div>',
    "washington_views_rows": f'<div class="thin-top-border-gray views-row"><div class="views-field-title"><a href="{_L}">{_N}</a></div><div class="views-field-field-job-title"><span class="field-content">{_T}</span></div><div class="views-field-field-email"><a href="mailto:{_M}">{_M}</a></div></div>',
    "gatech_people_grid": f'<div class="people"><ul class="grid"><li><div class="p-name"><a href="{_L}">{_N}</a></div>{_M}</li></ul></div>',
    "northwestern_people_articles": f'<article class="people"><h3><a href="{_L}">{_N} (on leave)</a></h3><p class="title">{_T}</p><a href="mailto:{_M}">{_M}</a></article>',
    "wisc_faculty_cards": f'<div class="faculty-member"><a class="faculty-name" href="{_L}">{_N}</a><p class="position-title">Position title: {_T}</p>{_M}</div>',
    "uchicago_people_list": f'<ul><li class="mix faculty"><a href="{_L}"><div class="people_img"><h5>{_N}</h5></div></a><div class="people_content"><h3><span>{_N}</span><b>{_T}</b></h3>{_M}</div></li></ul>',
    "yale_people_table": f'<table class="views-table"><tr><td class="views-field-name"><a class="username" href="{_L}">{_N}</a><br>{_T}</td><td>{_M}</td></tr></table>',
    "ucsb_directory_rows": f'<div class="views-row"><div class="group-second"><h3><a href="{_L}">{_N}</a></h3><div>{_T}</div></div><div>{_M}</div></div>',
    None: f'<ul><li class="x"><a href="{_L}">{_N}</a><br>{_T}<br>{_M}</li></ul>',
}
_KINDS = list(_CARDS)


@query(f"""SELECT CAST(s_nationkey * {len(_KINDS)} + s_suppkey % {len(_KINDS)} AS BIGINT) AS page_id, ['{"', '".join(k or "generic" for k in _KINDS)}'][s_suppkey % {len(_KINDS)} + 1] AS layout,
  CAST(row_number() OVER (PARTITION BY s_nationkey, s_suppkey % {len(_KINDS)} ORDER BY s_suppkey) - 1 AS INT) AS position, 'Ann ' || s_name AS name, CASE WHEN s_suppkey % {len(_KINDS)} <> {_KINDS.index("gatech_people_grid")} THEN 'Professor & Chair' END AS title,
  CASE WHEN s_suppkey % {len(_KINDS)} <> {_KINDS.index("gatech_people_grid")} THEN 's' || s_suppkey || '@example.org' END AS email, 'https://example.org/p/' || s_suppkey AS profile_url FROM supplier""")
def roster_every_layout(spark, d):
    """All suppliers on pages of their nation and of each of the layouts in turn."""
    kind = (F.col("s_suppkey") % len(_KINDS)).cast("int")
    card = F.element_at(F.array(*[F.lit(c) for c in _CARDS.values()]), kind + 1)
    for mark, value in (("{n}", F.concat(F.lit("Ann "), "s_name")), ("{l}", F.concat(F.lit("/p/"), F.col("s_suppkey").cast("string"))), ("{m}", F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("@Example.org")))):
        card = F.replace(card, F.lit(mark), value)
    hint = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), kind + 1)
    cards = view(spark, d, "supplier").select((F.col("s_nationkey") * len(_KINDS) + kind).cast("bigint").alias("page_id"), hint.alias("parser_hint"), "s_suppkey", card.alias("card"))
    found = cards.groupBy("page_id", "parser_hint").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "card"))), lambda c: c["card"]), "").alias("html"))
    rosters = pages.rosters(found.withColumn("url", F.lit("https://example.org/people")))
    return rosters.join(found.select("page_id", F.coalesce("parser_hint", F.lit("generic")).alias("layout")), "page_id").select("page_id", "layout", "position", "name", "title", "email", "profile_url")


_BIO = "Works on the theory of light and on quantum matter since the year "


@query(f"""SELECT CAST(s_suppkey AS BIGINT) AS page_id, 'Professor of ' || s_name AS title, CASE WHEN s_suppkey % 3 > 0 THEN 's' || s_suppkey || '@example.org' END AS email,
  CASE WHEN s_suppkey % 4 < 3 THEN '{_BIO}' || (1900 + s_suppkey) END AS profile_text FROM supplier""")
def profile_fields(spark, d):
    """Titles and texts at their selectors or found in the body, with noise beside them."""
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    bio = F.concat(F.lit(_BIO), (F.col("s_suppkey") + 1900).cast("string"))
    title = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('<div class="person-title">Professor of '), name, F.lit("</div>"))).otherwise(F.concat(F.lit("<p>Professor of "), name, F.lit("</p>")))
    text_ = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit('<div class="profile-bio">'), bio, F.lit("</div>"))).when(F.col("s_suppkey") % 4 < 3, F.concat(F.lit("<p>"), bio, F.lit("</p>"))).otherwise("<p>short one</p>")
    mail = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("<p>S"), key, F.lit("@Example.org</p>"))).otherwise("")
    noise = F.lit("<p>Contact info and office phone of the person named above are listed here</p>")
    rows = view(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("page_id"), F.lit("https://example.org/p").alias("url"), F.concat(F.lit("<html><body><main>"), title, noise, text_, mail, F.lit("</main></body></html>")).alias("html"))
    return pages.profiles(rows).select("page_id", "title", "email", "profile_text")


# -- changes


_JOB = "CASE p_size % 4 WHEN 0 THEN 'Associate Professor' WHEN 1 THEN 'Postdoctoral Fellow' WHEN 2 THEN 'Adjunct Professor' ELSE p_type END"


@query(f"""WITH found AS (SELECT p_partkey AS candidate_id, p_name AS name, string_split({_case("lower(" + _JOB + ")", _TITLES, "ambiguous/ambiguous/unrecognized_title")}, '/') AS t FROM part),
old AS (SELECT p_partkey AS candidate_id, p_partkey + 5 AS professor_id, 1 AS duplicate_of, CASE WHEN p_partkey % 3 = 0 THEN 'same_author' ELSE 'same_university_name' END AS duplicate_reason FROM part WHERE p_size % 2 = 0)
SELECT candidate_id, professor_id, t[2] AS verification_status, t[1] AS title_normalized, CASE WHEN t[2] = 'verified' OR duplicate_reason <> 'same_university_name' THEN duplicate_of END AS duplicate_of,
  CASE WHEN t[2] = 'verified' OR duplicate_reason <> 'same_university_name' THEN duplicate_reason END AS duplicate_reason FROM found LEFT JOIN old USING (candidate_id)""")
def professor_upsert(spark, d):
    """People judged anew; half of them were known before."""
    part = view(spark, d, "part")
    found = part.select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("name"), F.expr(_JOB).alias("title"))
    old = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("candidate_id"), (F.col("p_partkey") + 5).alias("professor_id"), F.lit(1).alias("duplicate_of"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'same_author' ELSE 'same_university_name' END").alias("duplicate_reason"))
    return pipeline.verified(found, old).select("candidate_id", "professor_id", "verification_status", "title_normalized", "duplicate_of", "duplicate_reason")


@query(f"""{cte("matches")} SELECT professor_id, CASE professor_id WHEN 7 THEN 'manual_override' ELSE match_status END AS match_status, CASE professor_id WHEN 7 THEN 'A99' ELSE author_id END AS author_id,
  CASE professor_id WHEN 7 THEN 1.0 ELSE match_score END AS match_score FROM matches""")
def match_set_by_hand(spark, d):
    return resolve.apply_decision(view(spark, d, "matches"), 7, "manual_override", "A99", "seen").select("professor_id", "match_status", "author_id", "match_score")


_PAYLOADS = "SELECT doc_id AS seq, 'W' || (doc_id % 700) AS id, doc_id % 90 AS professor_id, 'A' || (doc_id % 90) AS author_id, source, lang, n_chars FROM documents"


def _payloads(spark, d):
    """Work payloads, several to a work and to a person's work."""
    key = F.col("doc_id")
    topic = lambda name: F.struct(name.alias("display_name"), F.lit(None).cast("string").alias("name"))
    author = lambda who, place: F.struct(F.struct(who.alias("id")).alias("author"), place.alias("author_position"), (key % 2 == 0).alias("is_corresponding"))
    who = F.concat(F.lit("A"), (key % 90).cast("string"))
    none = F.array().cast("array<struct<display_name:string,name:string>>")
    return view(spark, d, "documents").select(
        key.alias("seq"), F.concat(F.lit("W"), (key % 700).cast("string")).alias("id"), (key % 90).alias("professor_id"), who.alias("author_id"), F.col("source").alias("title"), F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"),
        F.lit(2020).alias("publication_year"), F.lit(None).cast("string").alias("publication_date"), F.lit(None).cast("string").alias("doi"), F.col("n_chars").cast("int").alias("cited_by_count"), F.struct(F.struct(F.col("lang").alias("display_name")).alias("source")).alias("primary_location"), F.lit("article").alias("type"),
        F.when(key % 3 == 0, F.array(topic(F.col("lang")))).otherwise(none).alias("concepts"), F.array(topic(F.lit("t"))).alias("topics"),
        F.array(author(F.lit("B"), F.lit("last")), author(F.when(key % 5 > 0, who), F.when(key % 4 > 0, F.lit("first")))).alias("authorships"),
    )


@query(f"""SELECT id AS external_id, source AS title, CAST(n_chars AS INT) AS cited_by_count, lang AS source_name, '[{{"display_name":"' || CASE WHEN seq % 3 = 0 THEN lang ELSE 't' END || '"}}]' AS topics_json
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM ({_PAYLOADS})) WHERE nth = 1""")
def works_upsert(spark, d):
    return works.parse_works(_payloads(spark, d).drop("professor_id", "author_id", "authorships")).select("external_id", "title", "cited_by_count", "source_name", "topics_json")


@query(f"""SELECT professor_id, id AS external_id, CASE WHEN seq % 5 > 0 AND seq % 4 > 0 THEN 'first' ELSE 'unknown' END AS authorship_position, CASE WHEN seq % 5 > 0 THEN seq % 2 = 0 END AS is_corresponding
FROM (SELECT *, row_number() OVER (PARTITION BY professor_id, id ORDER BY seq DESC) AS nth FROM ({_PAYLOADS})) WHERE nth = 1""")
def links_upsert(spark, d):
    return works.author_links(_payloads(spark, d))


@query("""WITH new AS (SELECT CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE -vec_id END AS work_id FROM embeddings)
SELECT work_id, 'new' AS backend FROM new UNION ALL SELECT vec_id, 'old' FROM embeddings WHERE vec_id NOT IN (SELECT work_id FROM new)""")
def vectors_upsert(spark, d):
    rows = view(spark, d, "embeddings")
    old = rows.select(F.col("vec_id").alias("work_id"), "embedding", F.lit("old").alias("backend"))
    new = rows.select(F.expr("CASE WHEN vec_id % 3 = 0 THEN vec_id ELSE -vec_id END").alias("work_id"), "embedding", F.lit("new").alias("backend"))
    return store.upsert(old, new, ["work_id"]).select("work_id", "backend")


@query("SELECT vec_id AS work_id, len(embedding) AS dimension FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def vectors_by_ids(spark, d):
    stored = view(spark, d, "embeddings").select(F.col("vec_id").alias("work_id"), "embedding")
    return vectors.by_ids(stored, view(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("work_id"))).select("work_id", F.size("embedding").alias("dimension"))


@query("SELECT doc_id AS work_id, round(len(text) / sqrt(len(text) * len(text) + 1.0), 6) AS first, 2 AS dimension FROM documents WHERE text IS NOT NULL")
def dense_encoder(spark, d):
    """An encoder of the caller's: here a text's length and a one."""

    def make():
        return lambda texts: [[len(t), 1.0] for t in texts]

    out = vectors.dense_embed(view(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("work_id"), "text"), "work_id", "text", make, 2)
    return out.select("work_id", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").alias("dimension"))


@query("""WITH old AS (SELECT 'order' AS source, CAST(o_orderkey AS VARCHAR) AS grant_id, o_custkey AS professor_id, 1.0 AS amount FROM orders WHERE o_orderkey % 2 = 0),
new AS (SELECT 'order' AS source, CAST(o_orderkey AS VARCHAR) AS grant_id, -o_custkey AS professor_id, o_totalprice AS amount FROM orders WHERE o_orderkey % 3 > 0)
SELECT source, grant_id, coalesce(o.professor_id, n.professor_id) AS professor_id, CAST(coalesce(n.amount, o.amount) AS DOUBLE) AS amount FROM old o FULL JOIN new n USING (source, grant_id)""")
def grants_upsert(spark, d):
    """Grants found again, for another person, keep the one they were found for first."""
    rows = view(spark, d, "orders").select("o_orderkey", F.lit("order").alias("source"), F.col("o_orderkey").cast("string").alias("grant_id"), F.col("o_custkey").alias("professor_id"), F.col("o_totalprice").cast("double").alias("amount"))
    old = rows.where("o_orderkey % 2 = 0").select("source", "grant_id", "professor_id", F.lit(1.0).alias("amount"))
    again = rows.where("o_orderkey % 3 > 0").select("source", "grant_id", (-F.col("professor_id")).alias("professor_id"), "amount")
    new = again.withColumn("seq", F.lit(2)).unionByName(again.withColumns({"amount": F.lit(-1.0), "seq": F.lit(1)}))
    return funding.upsert_grants(old, new)


@query(f"{cte('grants')} SELECT professor_id, grant_id, end_date, CAST(row_number() OVER (PARTITION BY professor_id ORDER BY end_date DESC NULLS LAST, grant_id) AS INT) AS place, coalesce(end_date >= '{TODAY}', false) AS active FROM grants")
def grants_of_people_by_end(spark, d):
    return funding.grants_by_end(view(spark, d, "grants")).select("professor_id", "grant_id", "end_date", "place", funding.is_active(F.col("end_date"), TODAY).alias("active"))


@query(f"{cte('members')} SELECT professor_id, name, CAST(NULL AS VARCHAR) AS ror_id, CAST(NULL AS INT) AS h_index FROM members")
def additive_columns(spark, d):
    rows = store.add_columns(view(spark, d, "members"), {"name": "string", "ror_id": "string", "h_index": "int"})
    return rows.select("professor_id", "name", "ror_id", "h_index")


@query("SELECT * FROM (VALUES ('load', 'completed', 3, CAST(NULL AS INT)), ('match', 'in_progress', NULL, 7), ('works', 'not_started', NULL, NULL)) t(stage_name, status, processed_items, checkpoint)")
def stage_states(spark, d):
    """States written, changed and read again."""
    s = store.Store(spark, _scratch(spark, "states"))
    s.put_state("load", status="in_progress")
    s.put_state("load", status="completed", processed_items=3)
    s.put_state("match", status="in_progress", checkpoint=7)
    found = [s.get_state(n) for n in ("load", "match", "works")]
    return spark.createDataFrame([(r["stage_name"], r["status"], r["processed_items"], r["checkpoint"]) for r in found], "stage_name string, status string, processed_items int, checkpoint int")


# -- files and texts


@query("SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS query_id, 'q ' || item_id AS query, CASE WHEN item_id % 2 = 0 THEN 1 END AS minimum_professor_matches, CAST(item_id % 3 AS INT) AS expected FROM benchmark")
def evaluation_file(spark, d):
    path = _scratch(spark, "evaluation")
    some = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: k <= F.col("item_id") % 3), lambda k: F.concat(F.lit("p"), k.cast("string")))
    view(spark, d, "benchmark").repartition(4, "item_id").select(F.col("item_id").alias("pos"), F.concat(F.lit("q "), F.col("item_id").cast("string")).alias("query"), F.when(F.col("item_id") % 2 == 0, 1).alias("minimum_professor_matches"), some.alias("expected_professors")).write.json(path)
    return evaluate.load_queries(spark, path).select(F.col("query_id").cast("int").alias("query_id"), "query", "minimum_professor_matches", F.size("expected_professors").alias("expected"))


@query("""SELECT 'id,name,university,department,profile_url,added_at' AS line UNION ALL
SELECT p_partkey || ',"' || p_name || ', ""x"" ",' || p_brand || ',' || p_type || ',,2024-01-01' FROM part""")
def shortlist_csv(spark, d):
    path = _scratch(spark, "shortlist")
    rows = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "x" ')).alias("name"), F.col("p_brand").alias("university"), F.col("p_type").alias("department"), F.lit(None).cast("string").alias("profile_url"), F.lit("2024-01-01").alias("added_at"))
    export.write_shortlist(rows.repartition(4, "id"), path, one_file=False)
    return spark.read.text(path).select(F.col("value").alias("line")).distinct()  # each file has the header


_WHOLE = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN length({_WHOLE}) <= 900 THEN {_WHOLE} ELSE regexp_replace(substr({_WHOLE}, 1, 900), ' [^ ]*$', '') || '…' END AS short FROM documents")
def truncate_text(spark, d):
    return view(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@query("SELECT p_partkey, p_name AS value FROM part")
def text_after_marker(spark, d):
    prompt = F.concat(F.lit("Professor title: x\nPaper 1 title: "), F.lit('"'), "p_name", F.lit('"\nPaper 1 year: 2020'))
    return view(spark, d, "part").select("p_partkey", text.after_marker(prompt, "Paper 1 title: ").alias("value"))


@query(f"""{cte("universities", "people", "works", "links")}, own AS (SELECT w.*, row_number() OVER (ORDER BY publication_year DESC NULLS LAST, cited_by_count DESC NULLS LAST, work_id DESC) AS place FROM links JOIN works w USING (work_id) WHERE professor_id = 5)
SELECT p.name, u.name AS university_name, CAST(place AS INT) AS place, work_id, o.title FROM people p JOIN universities u USING (university_id), own o WHERE p.professor_id = 5 AND place <= 2""")
def email_works(spark, d):
    """What an e-mail to a person is written from."""
    return outreach.context(5, *[view(spark, d, n) for n in ("people", "universities", "links", "works")]).select("name", "university_name", "place", "work_id", "title")


_ABSTRACT = "regexp_replace(coalesce(abstract, ''), '^\\s+|\\s+$', '', 'g')"
_PROMPTS = f"""{cte("universities", "people", "works", "links")}, placed AS (
SELECT professor_id, w.*, row_number() OVER (PARTITION BY professor_id ORDER BY publication_year DESC NULLS LAST, cited_by_count DESC NULLS LAST, work_id DESC) AS place FROM links JOIN works w USING (work_id)),
told AS (SELECT professor_id, place, 'Paper ' || place || ' title: ' || coalesce(title, '') || chr(10) || 'Paper ' || place || ' year: ' || coalesce(CAST(publication_year AS VARCHAR), 'unknown') || chr(10) || 'Paper ' || place || ' abstract: ' ||
  CASE WHEN length({_ABSTRACT}) <= 900 THEN {_ABSTRACT} ELSE regexp_replace(substr({_ABSTRACT}, 1, 900), ' [^ ]*$', '') || '…' END AS line FROM placed WHERE place <= 2),
prompts AS (SELECT p.professor_id, p.name, 'Professor name: ' || p.name || chr(10) || 'Professor title: ' || p.title || chr(10) || 'University: ' || u.name || chr(10) || string_agg(line, chr(10) ORDER BY place) || chr(10)
  || 'Applicant name: Kim' || chr(10) || 'Applicant interest: quantum noise' || chr(10) || 'Applicant background: ' || chr(10) || 'Applicant stage: PhD applicant' AS prompt
  FROM people p JOIN universities u USING (university_id) JOIN told USING (professor_id) GROUP BY p.professor_id, p.name, p.title, u.name)"""


def _prompts(spark, d):
    return outreach.prompts(*[view(spark, d, n) for n in ("people", "universities", "links", "works")], outreach.Applicant("quantum noise", "Kim"))


@query(_PROMPTS + " SELECT professor_id, prompt FROM prompts")
def email_prompts(spark, d):
    """What a backend is told of each person, for all people."""
    return _prompts(spark, d).select("professor_id", "prompt")


@query(_PROMPTS + " SELECT professor_id, 'echo' AS backend, length(prompt) AS told FROM prompts")
def email_drafts(spark, d):
    """Drafts for all people; the echo returns what it is told."""
    out = outreach.drafts(_prompts(spark, d), outreach.Echo)
    return out.select("professor_id", "backend", F.char_length(F.substring_index("body", "[user]\n", -1)).alias("told"))
