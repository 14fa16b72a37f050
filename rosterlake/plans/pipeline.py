"""The seven stages from a seed file to ranked people.

Each stage reads tables of the store, plans their successors as DataFrames and
writes each as one snapshot.  Remote stages take a function that makes a fetcher.
A stage that ends in an error is marked failed and the run stops there; a stage
marked in progress (its process died) resumes after its checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import names, text, vectors
from ..operators import funding, identity, nameindex, resolve, search, searchindex, works
from ..sources import fetch, pages, seed
from ..scratch import shared_dir
from .artifacts import Reporter
from .store import Conflict, Store, add_columns, latest, upsert, with_ids

TABLES = {
    "universities": "university_id bigint, name string, short_name string, qs_rank_2026 int, qs_score double, domain string, openalex_id string, ror_id string, state string, status string",
    "sources": "source_id bigint, university string, department_type string, roster_url string, parser_hint string, status string, error_message string",
    "candidates": "candidate_id bigint, university_id bigint, source_id bigint, department_type string, name string, normalized_name string, title string, email string, profile_url string, profile_text string, source_url string, source_snippet string",
    "people": "professor_id bigint, candidate_id bigint, university_id bigint, department_type string, name string, normalized_name string, title string, title_normalized string, email string, profile_url string, profile_text string, source_url string, source_snippet string, verification_status string, duplicate_of bigint, duplicate_reason string",
    "matches": "professor_id bigint, author_id string, match_status string, match_score double, evidence string",
    "works": "work_id bigint, external_id string, title string, abstract string, publication_year int, publication_date string, doi string, cited_by_count int, source_name string, type string, topics_json string",
    "links": "professor_id bigint, work_id bigint, authorship_position string, is_corresponding boolean",
    "vectors": "work_id bigint, dimension int, embedding array<double>, backend string",
    "grants": "professor_id bigint, source string, grant_id string, title string, pi_name string, amount double, start_date string, end_date string",
}

KEYS = {"universities": ["university_id"], "sources": ["source_id"], "candidates": ["candidate_id"], "people": ["professor_id"], "matches": ["professor_id"], "works": ["external_id"], "links": ["professor_id", "work_id"], "vectors": ["work_id"], "grants": ["source", "grant_id"]}


@dataclass
class Context:
    spark: SparkSession
    store: Store
    settings: Settings
    fetcher: Callable[..., fetch.Fetcher] | None = None
    limit: int | None = None
    today: str = ""
    reporter: Reporter | None = None
    notes: dict = field(default_factory=dict)
    #: Encoders beside "hash": by backend, a function that loads one.
    encoders: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        shared_dir(self.spark)

    @property
    def shares(self) -> int:
        """Tasks that may ask the author service at once."""
        return self.fetcher.shares if isinstance(self.fetcher, fetch.HttpMaker) else 1

    def table(self, name: str) -> DataFrame:
        columns = dict(c.strip().split(" ", 1) for c in TABLES[name].split(", "))
        return add_columns(self.store.read(name, TABLES[name]), columns).select(*columns)

    def put(self, name: str, rows: DataFrame) -> int:
        """Replace a table; returns its rows, counted by the write."""
        return self.store.write(name, _typed(name, rows))

    def merge(self, name: str, rows: DataFrame, keep: list[str] | None = None) -> int:
        """Put rows in place of, or beside, those of equal key; returns how many, counted
        by the write."""
        return self.store.merge(name, _typed(name, rows), KEYS[name], keep)

    def count(self, name: str) -> int:
        n = self.store.rows(name)
        return self.table(name).count() if n is None else n


def _typed(name: str, rows: DataFrame) -> DataFrame:
    columns = dict(c.strip().split(" ", 1) for c in TABLES[name].split(", "))
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def _number(ctx: Context, name: str, rows: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """``rows`` with new ids where they have none."""
    old = ctx.table(name)
    fresh = with_ids(rows.where(F.col(ident).isNull()).drop(ident), old, ident, order)
    return rows.where(F.col(ident).isNotNull()).unionByName(fresh.select(rows.columns))


def load_seed(ctx: Context) -> dict:
    items = seed.read_seed(ctx.spark, ctx.settings.app.seed_file, ctx.limit)
    found = seed.sources(items)
    wrong = seed.off_domain(found).take(1)
    if wrong:
        raise ValueError(f"{wrong[0]['roster_url']} is outside {wrong[0]['domain']}")
    old = ctx.table("sources")
    merged, changed = seed.merge_sources(old, found)
    ids = old.select("source_id", "university", "department_type", "roster_url")
    ctx.put("sources", _number(ctx, "sources", merged.join(ids, ["university", "department_type", "roster_url"], "left"), "source_id", ["university", "roster_url", "department_type"]))
    all_universities = ctx.table("universities")
    rows = seed.merge_universities(all_universities, items, changed).join(all_universities.select("university_id", "name"), "name", "left")
    ctx.put("universities", _number(ctx, "universities", rows, "university_id", ["name"]))
    return {"universities_loaded": items.count()}


SCRAPED = "source_id bigint, error string, " + pages.ENTRY.replace("page_id bigint, ", "")


def _scrape(f: fetch.Fetcher, row: dict):
    """Entries of a source's pages, with what profile pages add; an error gives one
    row that says so.  No host outside the university's domain is asked."""
    hint = row["parser_hint"]
    domain = row.get("domain")
    f = fetch.Within(f, {domain}) if isinstance(domain, str) and domain else f
    follow = (lambda page, url: []) if hint in pages.SINGLE_PAGE else pages.further_pages
    try:
        found = [e for _, url, page in fetch.crawl(f, row["roster_url"], follow) for e in pages.roster_entries(page, url, hint)]
        whole = []
        for e in pages.once(found, "normalized_name", "profile_url", "source_url"):
            try:
                status, url, page = f.get(e["profile_url"]) if e["profile_url"] and not (e["title"] and e["email"]) else (0, "", "")
                e = pages.enrich(e, page if status == 200 else None, url)
            except Exception:  # noqa: BLE001  a profile page is a bonus
                pass
            whole.append(e)
        for k, e in enumerate(pages.once(whole, "normalized_name", "profile_url", "source_url")):
            yield {"source_id": row["source_id"], "error": None, "position": k} | e
    except Exception as e:  # noqa: BLE001  one source's failure is that source's state
        yield {"source_id": row["source_id"], "error": str(e) or type(e).__name__}


def scrape(ctx: Context) -> dict:
    todo = seed.needs_scrape(ctx.table("sources"))
    todo = works.resume(todo, "source_id", None, ctx.limit).checkpoint()
    domains = ctx.table("universities").select(F.col("name").alias("university"), "domain")
    asked = todo.select("source_id", "university", "roster_url", "parser_hint").join(domains, "university", "left")
    read = lambda f, row: ({"source_id": row["source_id"], "payload": json.dumps(e)} for e in _scrape(f, row))
    found = _fetched(ctx, "scrape", asked, "source_id", read, "source_id bigint, payload string", by="university")
    got = found.select("source_id", F.from_json("payload", SCRAPED.replace("source_id bigint, ", "")).alias("e")).select("source_id", "e.*").checkpoint()
    errors = got.where("error IS NOT NULL").select("source_id", F.col("error").alias("message"))
    entries = got.where("error IS NULL").drop("error")
    upsert_entries(ctx, entries, todo)
    state = todo.select("source_id").join(errors, "source_id", "left").withColumnRenamed("message", "m")
    state = state.select("source_id", F.when(F.col("m").isNull(), "scraped").otherwise("error").alias("s"), "m")
    rows = ctx.table("sources").join(state, "source_id")
    ctx.merge("sources", rows.withColumns({"error_message": F.col("m"), "status": F.col("s")}))
    _mark_universities(ctx, todo.join(state.where("s = 'scraped'"), "source_id").select(F.col("university").alias("name")), "faculty_scraped")
    return {"sources_processed": todo.count(), "candidates": ctx.count("candidates")}


def upsert_entries(ctx: Context, entries: DataFrame, todo: DataFrame) -> None:
    """Candidates by profile link within a source, else by name within it."""
    from .store import target_ids

    old = ctx.table("candidates")
    new = target_ids(entries, old, "candidate_id", ["source_id", "profile_url"], ["source_id", "normalized_name"])
    # an entry that updates a candidate is told by its id, a new one by source and link or name
    told = {"target": F.col("candidate_id"), "target_source": F.when(F.col("candidate_id").isNull(), F.col("source_id")), "target_link": F.when(F.col("candidate_id").isNull(), F.coalesce("profile_url", "normalized_name"))}
    new = latest(new.withColumns(told), list(told), "position").drop(*told)
    where = seed.placed(todo.select("source_id", "university", F.col("department_type")), ctx.table("universities")).drop("university")
    rows = _number(ctx, "candidates", new.join(where, "source_id").select(old.columns), "candidate_id", ["source_id", "normalized_name", "profile_url"])
    ctx.merge("candidates", rows)


def _mark_universities(ctx: Context, which: DataFrame, status: str) -> None:
    rows = ctx.table("universities").join(which.distinct(), "name", "left_semi")
    ctx.merge("universities", rows.withColumn("status", F.lit(status)))


def verified(candidates: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of people for candidates, judged by title.  A person known before keeps its id
    and marks, but for a duplicate's mark that only verified people bear."""
    t = text.classify_title(F.col("title"))
    known = old.select("candidate_id", "professor_id", "duplicate_of", "duplicate_reason")
    rows = candidates.join(known, "candidate_id", "left").withColumn("title_normalized", t["normalized_title"]).withColumn("verification_status", t["status"])
    stale = (F.col("verification_status") != "verified") & F.col("duplicate_reason").eqNullSafe(identity.SAME_NAME)
    return rows.withColumns({c: F.when(~stale, F.col(c)) for c in ("duplicate_of", "duplicate_reason")})


def verify(ctx: Context) -> dict:
    old = ctx.table("people")
    found = works.resume(ctx.table("candidates"), "candidate_id", None, ctx.limit)
    rows = _number(ctx, "people", verified(found, old).select(old.columns), "professor_id", ["candidate_id"])
    n = ctx.put("people", identity.same_name(upsert(old, rows, ["candidate_id"])))
    name_index(ctx)
    return {"candidates_processed": n, "verified_professors": ctx.table("people").where("verification_status = 'verified'").count()}


#: Rows that are fetched, and kept, at once, for each task that asks; works that are
#: embedded, and committed, at once.
JOURNAL_ROWS, EMBED_ROWS = 200, 1_000_000


def _fetched(ctx: Context, stage: str, todo: DataFrame, key: str, read: Callable, schema: str, shares: int = 1, by: str | None = None) -> DataFrame:
    """What ``read`` yields for each row of ``todo``, which has ``key`` once.  Answers are
    kept in the store's journal part by part, so a run that resumes asks only for what is
    missing; ``run`` clears the journal when the stage is completed.  Tasks ask by host, if
    ``by`` tells it, or as many as a service's limit has ``shares``."""
    journal = f"{ctx.store.path}/journal/{stage}"
    names = [c.strip().split()[0] for c in schema.split(",")]

    def marked(f, row):
        found = list(read(f, row))
        yield from found or [{key: row[key]}]
        # a row without an answer is asked for once all the same

    def kept(paths: list[str]) -> DataFrame:
        return ctx.spark.read.schema(schema).parquet(*paths) if paths else ctx.spark.createDataFrame([], schema)

    left = todo.join(kept(ctx.store.folders(journal)).select(key).distinct(), key, "left_anti").checkpoint()
    parts = -(-left.count() // (JOURNAL_ROWS * (ctx.spark.sparkContext.defaultParallelism if by else shares)))
    for k in range(parts):
        some = left.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        fetched = fetch.fetch_each(some.repartition(by), ctx.fetcher, marked, schema) if by else fetch.fetch_each(some, ctx.fetcher, marked, schema, shares)
        fetched.write.parquet(f"{journal}/{uuid.uuid4().hex}")
    out = kept(ctx.store.folders(journal))
    return out.join(todo.select(key), key, "left_semi").where(F.col(names[-1]).isNotNull())


def match(ctx: Context) -> dict:
    s, base = ctx.settings, ctx.settings.authors.base_url
    people, matches = identity.reset_author_duplicates(ctx.table("people"), ctx.table("matches"))
    matches = identity.sync_duplicates(people, matches).checkpoint()
    people = people.checkpoint()
    ready = people.where((F.col("verification_status") == "verified") & F.col("duplicate_of").isNull())
    state = ctx.store.get_state("match")
    last = (state["checkpoint"] or {}).get("last_professor_id") if ctx.notes.get("resume") else None
    todo = works.resume(resolve.needs_matching(ready, matches).select(people.columns), "professor_id", last, ctx.limit)
    places = ctx.table("universities").select("university_id", F.col("openalex_id").alias("institution_id"))
    todo = todo.join(places, "university_id").checkpoint()
    per_page, most = s.authors.per_page, s.authors.max_candidates

    def read(f, row):
        for v, p, author in fetch.candidates(f, base, list(row["variants"]), per_page):
            yield {"professor_id": row["professor_id"], "variant": v, "pos": p, "payload": json.dumps(author)}

    asked = todo.select("professor_id", names.name_variants(F.col("name")).alias("variants"))
    got = _fetched(ctx, "match", asked, "professor_id", read, "professor_id bigint, variant int, pos int, payload string", ctx.shares)
    found = resolve.merge_candidates(got.select("professor_id", "variant", "pos", F.from_json("payload", resolve.CANDIDATE).alias("candidate")), most)
    decided = resolve.decide(todo, resolve.score_candidates(todo, found), s.matching.threshold, s.matching.ambiguity_margin)
    matches = upsert(matches, decided.select(matches.columns), ["professor_id"]).checkpoint()
    people, matches = identity.same_author(people, matches)
    ctx.put("people", people.checkpoint())
    ctx.put("matches", matches)
    name_index(ctx)
    _mark_universities(ctx, todo.join(ctx.table("universities").select("university_id", F.col("name").alias("u")), "university_id").select(F.col("u").alias("name")), "matched")
    return {"professors_processed": todo.count(), "matched": ctx.table("matches").where("match_status = 'matched'").count()}


def ingest_works(ctx: Context) -> dict:
    p, base = ctx.settings.publications, ctx.settings.authors.base_url
    start, per_page, most = p.start_year, p.per_page, p.max_pages_per_author
    todo = works.resume(works.needs_works(ctx.table("people"), ctx.table("matches"), ctx.table("links")), "professor_id", None, ctx.limit)
    todo = todo.select("professor_id", "author_id", "university_id").checkpoint()

    def read(f, row):
        for k, work in enumerate(fetch.author_works(f, base, row["author_id"], start, per_page, most)):
            yield {"professor_id": row["professor_id"], "author_id": row["author_id"], "seq": row["professor_id"] * 100_000 + k, "payload": json.dumps(work)}

    got = _fetched(ctx, "works", todo, "professor_id", read, "professor_id bigint, author_id string, seq bigint, payload string", ctx.shares)
    payloads = got.select("professor_id", "author_id", "seq", F.from_json("payload", works.WORK).alias("w")).select("professor_id", "author_id", "seq", "w.*").where("id IS NOT NULL")
    seen = save_works(ctx, payloads)
    _mark_universities(ctx, todo.join(ctx.table("universities").select("university_id", "name"), "university_id").select("name"), "completed")
    return {"authors_processed": todo.count(), "works_processed": seen}


def save_works(ctx: Context, payloads: DataFrame, links: bool = True) -> int:
    """Upsert works by their id and, if asked for, links by (person, work) from payload
    rows."""
    old = ctx.table("works")
    new = works.parse_works(payloads.drop("professor_id", "author_id")).join(old.select("external_id", "work_id"), "external_id", "left")
    ctx.merge("works", _number(ctx, "works", new.select(old.columns), "work_id", ["external_id"]))
    if links:
        save_links(ctx, payloads)
    return payloads.count()


def save_links(ctx: Context, payloads: DataFrame) -> int:
    """Upsert links by (person, work) from payload rows of works that are known."""
    ids = ctx.table("works").select("external_id", "work_id")
    return ctx.merge("links", works.author_links(payloads.where(F.col("professor_id").isNotNull())).join(ids, "external_id").drop("external_id"))


def embed(ctx: Context) -> dict:
    e, old = ctx.settings.embeddings, ctx.table("vectors")
    if e.backend != "hash":
        vectors.encoder(e.backend, ctx.encoders)
    todo = works.resume(works.needs_embedding(ctx.table("works"), old, e.backend, e.dimension), "work_id", None, ctx.limit)
    body = todo.select("work_id", vectors.embedding_text(F.col("title"), F.col("abstract")).alias("body")).checkpoint()
    parts, done = -(-body.count() // EMBED_ROWS), 0
    for k in range(parts):  # each is committed; a run that resumes finds only what is missing
        some = body.where(F.pmod(F.xxhash64("work_id"), F.lit(parts)) == k)
        made = vectors.embed(some, "work_id", "body", e.backend, e.dimension, ctx.encoders)
        done += ctx.merge("vectors", made.select("work_id", F.lit(e.dimension).alias("dimension"), "embedding", F.lit(e.backend).alias("backend")))
    index(ctx)
    return {"works_embedded": done}


#: Tables that the search index is made of.
INDEXED = ("works", "vectors", "links")


def _made_of(ctx: Context) -> dict:
    return {n: max(ctx.store.versions(n), default=0) for n in INDEXED} | {"backend": ctx.settings.embeddings.backend}


def index(ctx: Context) -> None:
    """Make the search index, if what it was made of has changed."""
    now = _made_of(ctx)
    if ctx.store.get_state("index")["checkpoint"] != now:
        prepared, _ = search.index({n: ctx.table(n) for n in INDEXED}, now["backend"])
        ctx.store.write("prepared", prepared)
        ctx.store.write("profiles", searchindex.profiles(ctx.store.read("prepared"), ctx.table("links")))
        ctx.store.put_state("index", status="completed", checkpoint=now)


def name_index(ctx: Context) -> None:
    """Make the postings of people's names, if people have changed."""
    now = {"people": max(ctx.store.versions("people"), default=0)}
    if ctx.store.get_state("names")["checkpoint"] != now:
        ctx.store.write("name_postings", nameindex.postings(ctx.table("people")).drop("bucket"), key=["trigram"])
        ctx.store.put_state("names", status="completed", checkpoint=now)


def names_by_part(ctx: Context) -> Callable[[DataFrame], DataFrame] | None:
    """Postings for a table of trigrams, if they are as new as people."""
    fresh = ctx.store.get_state("names")["checkpoint"] == {"people": max(ctx.store.versions("people"), default=0)}
    return (lambda trigrams: ctx.store.get("name_postings", trigrams)) if fresh and ctx.store.exists("name_postings") else None


def search_tables(ctx: Context) -> dict[str, DataFrame]:
    """All tables, and the search index if it is as new as what it was made of."""
    out = {n: ctx.table(n) for n in TABLES}
    if ctx.store.get_state("index")["checkpoint"] == _made_of(ctx):
        out |= {n: ctx.store.read(n) for n in ("prepared", "profiles")}
    return out


def fund(ctx: Context) -> dict:
    c = ctx.settings.funding
    todo = works.resume(funding.to_look_up(ctx.table("people"), ctx.table("universities")), "professor_id", None, ctx.limit)
    nih_url, nsf_url, per_page, most = c.nih_base_url, c.nsf_base_url, c.per_page, c.max_pages

    def read(f, row):
        for source, found in (("nih", fetch.nih_projects(f, nih_url, row["name"], row["institution"], per_page, most)), ("nsf", fetch.nsf_awards(f, nsf_url, row["name"], row["institution"], per_page, most))):
            for k, item in enumerate(found):
                yield {"professor_id": row["professor_id"], "source": source, "seq": k, "payload": json.dumps(item)}

    got = _fetched(ctx, "fund", todo, "professor_id", read, "professor_id bigint, source string, seq int, payload string")
    part = lambda source, schema: got.where(F.col("source") == source).select("professor_id", "seq", F.from_json("payload", schema).alias("p"))
    rows = None
    for source, schema, parse in (("nih", funding.NIH, funding.parse_nih), ("nsf", funding.NSF, funding.parse_nsf)):
        flat = part(source, schema).select(F.struct("professor_id", "seq").alias("seq"), "professor_id", "p.*")
        parsed = parse(flat, "professor_id", "seq")
        rows = parsed if rows is None else rows.unionByName(parsed)
    ctx.merge("grants", funding.last_grants(rows.where("grant_id != ''")), keep=["professor_id"])
    return {"professors_processed": todo.count(), "grants": ctx.count("grants")}


STAGES: list[tuple[str, Callable[[Context], dict]]] = [("load", load_seed), ("scrape", scrape), ("verify", verify), ("match", match), ("works", ingest_works), ("embed", embed), ("fund", fund)]


class StageFailed(RuntimeError):
    def __init__(self, stage: str, done: list[tuple[str, dict]], error: Exception):
        super().__init__(f"stage {stage} failed: {error}")
        self.stage, self.done = stage, done


#: Runs of a stage whose tables another writer keeps changing; versions of a table that stay.
TRIES, VERSIONS = 5, 3


def _staged(ctx: Context, stage: Callable[[Context], dict]) -> dict:
    """A stage's outcome; it runs again on the newer tables if another writer has changed
    one that it replaces.  Answers that it has fetched are in its journal."""
    for left in reversed(range(TRIES)):
        ctx.store.begin()
        try:
            return stage(ctx)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def run(ctx: Context, from_stage: str | None = None, through_stage: str | None = None) -> list[tuple[str, dict]]:
    """Run the stages in order, from and through the named ones."""
    order = [name for name, _ in STAGES]
    for name in (from_stage, through_stage):
        if name is not None and name not in order:
            raise ValueError(f"no stage {name}")
    lo = order.index(from_stage) if from_stage else 0
    hi = order.index(through_stage) if through_stage else len(order) - 1
    done: list[tuple[str, dict]] = []
    for name, stage in STAGES[lo : hi + 1]:
        ctx.notes["resume"] = ctx.store.get_state(name)["status"] == "in_progress"
        ctx.store.put_state(name, status="in_progress")
        if ctx.reporter:
            ctx.reporter.started(name)
        try:
            outcome = _staged(ctx, stage)
        except Exception as e:
            ctx.store.put_state(name, status="failed")
            if ctx.reporter:
                ctx.reporter.failed(name, e)
            raise StageFailed(name, done, e) from e
        ctx.store.remove(f"{ctx.store.path}/journal/{name}")
        for table in (*TABLES, "prepared", "profiles", "name_postings"):
            ctx.store.expire(table, VERSIONS)
        ctx.store.put_state(name, status="completed", processed_items=next(iter(outcome.values()), None))
        if ctx.reporter:
            ctx.reporter.completed(name, outcome)
        done.append((name, outcome))
    return done
