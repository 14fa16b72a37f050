import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from rosterlake import cli, config
from rosterlake.plans import artifacts, export, pipeline, store
from rosterlake.sources import fetch, seed
from rosterlake.streaming import ingest

ROSTER = "https://physics.example.edu/people"
ANN = '<li><a href="/ann">Ann Lee</a> Professor of quantum noise, ann@example.edu</li>'
BOB = '<li><a href="/bob">Bob Ray</a> Assistant Professor bob@example.edu</li><li><a href="/pat">Pat Doc</a> Postdoc with Professor Lee</li>'


def world():
    author = lambda key, name: {"id": key, "display_name": name, "last_known_institutions": [{"id": "I1"}], "x_concepts": [{"display_name": "Physics"}], "counts_by_year": [{"year": 2025, "works_count": 2}]}
    work = lambda key, title, who: {"id": key, "title": title, "abstract_inverted_index": {"Quantum": [0], "noise": [1]}, "publication_year": 2024, "primary_location": {"source": {"display_name": "Journal"}}, "topics": [{"display_name": "Physics"}], "authorships": [{"author": {"id": who}, "author_position": "first"}]}
    answers = {ROSTER: f"<ul>{ANN}</ul><a href='?page=1'>next</a>", f"{ROSTER}?page=1": f"<ul>{BOB}</ul>"}
    answers |= {f"https://a/authors?per-page=10&search={n.replace(' ', '+')}": json.dumps({"results": [author(k, n)]}) for k, n in (("A1", "Ann Lee"), ("A2", "Bob Ray"))}
    for a, titles in (("A1", ["Quantum noise", "Detectors"]), ("A2", ["Plants"])):
        answers[f"https://a/works?filter=author.id%3A{a}%2Cfrom_publication_date%3A2021-01-01&page=1&per-page=50"] = json.dumps({"meta": {"count": len(titles)}, "results": [work(f"W{a}{k}", t, a) for k, t in enumerate(titles)]})
    answers["https://n/projects/search"] = json.dumps({"results": [{"project_num": "G1", "project_title": "Grant", "award_amount": 5.0, "project_end_date": "2030-01-01"}]})
    return fetch.Recorded(answers)


@pytest.fixture
def ctx(spark, tmp_path):
    file = tmp_path / "seed.json"
    file.write_text(json.dumps([{"name": "Alpha University", "domain": "example.edu", "openalex_id": "I1", "departments": [{"department_type": "physics", "roster_url": ROSTER}]}]))
    s = config.Settings()
    s.app.seed_file, s.app.store_dir, s.app.runs_dir = str(file), f"file://{tmp_path}/store", str(tmp_path / "runs")
    s.embeddings.dimension, s.authors.base_url, s.funding.nih_base_url, s.funding.nsf_base_url = 64, "https://a", "https://n", "https://f"
    answers = world().answers
    return pipeline.Context(spark, store.Store(spark, s.app.store_dir), s, lambda: fetch.Recorded(answers))


def test_all_stages_and_a_second_run(spark, ctx, capsys, monkeypatch):
    ctx.reporter = artifacts.Reporter(ctx.settings.app.runs_dir, "test")
    done = dict(pipeline.run(ctx))
    assert [s for s, _ in pipeline.STAGES] == list(done)
    people = {r["name"]: r for r in ctx.table("people").collect()}
    assert {n: p["verification_status"] for n, p in people.items()} == {"Ann Lee": "verified", "Bob Ray": "verified", "Pat Doc": "excluded"}
    assert {r["author_id"] for r in ctx.table("matches").where("match_status = 'matched'").collect()} == {"A1", "A2"}
    assert ctx.table("works").count() == 3 and ctx.table("links").count() == 3 and ctx.table("vectors").count() == 3
    assert ctx.table("universities").first()["status"] == "completed" and ctx.table("sources").first()["status"] == "scraped"
    assert ctx.table("grants").count() == 1  # one grant, kept by the first person it was found for
    ids = {r["professor_id"]: r["name"] for r in ctx.table("people").collect()}
    again = dict(pipeline.run(ctx))
    assert {r["professor_id"]: r["name"] for r in ctx.table("people").collect()} == ids
    assert again["works"]["authors_processed"] == 0 and again["embed"]["works_embedded"] == 0 and again["scrape"]["sources_processed"] == 0
    assert ctx.reporter.finish(list(done.items()))["success"] and artifacts.latest_run(ctx.settings.app.runs_dir)["results"][0]["stage"] == "load"
    events = [json.loads(x) for x in (ctx.reporter.path / "events.jsonl").read_text().splitlines()]
    assert [e["event"] for e in events[:2]] == ["stage_started", "stage_completed"]
    # the same store by commands
    monkeypatch.setattr(config, "load", lambda *a: ctx.settings)
    say = lambda *a: (cli.main(list(a), spark), json.loads(capsys.readouterr().out))[1]
    assert say("search", "quantum noise")["hits"][0]["professor_name"] == "Ann Lee"
    assert {r["name"]: r["count"] for r in say("status")}["verified_professors"] == 2
    assert say("inspect", "--name", "bob")["person"][0]["author_id"] == "A2"
    say("resolve", "unmatched", "--name", "bob")
    assert {r["name"] for r in say("review")} == {"Bob Ray"} and ctx.table("links").count() == 2
    assert "Dear Professor Lee" in say("draft-email", str(people["Ann Lee"]["professor_id"]), "--interest", "noise")["body"]
    assert say("audit") == []


def test_a_changed_hint_queues_a_source_again(ctx):
    pipeline.run(ctx, through_stage="scrape")
    body = json.loads(open(ctx.settings.app.seed_file).read())
    body[0]["departments"][0]["parser_hint"] = "penn_people_rows"
    open(ctx.settings.app.seed_file, "w").write(json.dumps(body))
    pipeline.run(ctx, through_stage="load")
    assert ctx.table("sources").first()["status"] == "pending" and ctx.table("universities").first()["status"] == "pending"


def test_failures_are_kept(ctx):
    body = json.loads(open(ctx.settings.app.seed_file).read())
    body[0]["departments"][0]["roster_url"] = "https://elsewhere.example.com/x"
    open(ctx.settings.app.seed_file, "w").write(json.dumps(body))
    with pytest.raises(pipeline.StageFailed, match="load"):
        pipeline.run(ctx)
    assert ctx.store.get_state("load")["status"] == "failed"
    with pytest.raises(ValueError):
        pipeline.run(ctx, from_stage="nope")
    body[0]["departments"][0]["roster_url"] = "https://x.example.edu/missing"
    open(ctx.settings.app.seed_file, "w").write(json.dumps(body))
    pipeline.run(ctx, through_stage="scrape")
    row = ctx.table("sources").first()
    assert row["status"] == "error" and "404" in row["error_message"]


def test_stream_of_payload_files(spark, ctx, tmp_path):
    folder, seen = tmp_path / "in", f"file://{tmp_path}/seen"
    os.makedirs(folder)
    line = lambda key, title, seq: json.dumps({"professor_id": 1, "author_id": "A", "seq": seq, "id": key, "title": title}) + "\n"
    (folder / "1.json").write_text(line("W1", "old", 0) + line("W2", "other", 1))
    ingest.ingest(ctx, str(folder), seen).awaitTermination()
    (folder / "2.json").write_text(line("W1", "new", 2))
    ingest.ingest(ctx, str(folder), seen).awaitTermination()
    assert {r["external_id"]: r["title"] for r in ctx.table("works").collect()} == {"W1": "new", "W2": "other"}
    assert ctx.table("links").count() == 2


def test_a_stream_ends_as_one_batch_would(spark, ctx, tmp_path):
    """Late, repeated and stale arrivals over several files and restarts."""
    rng = random.Random(4)
    lines = [(f"W{rng.randrange(6)}", rng.choice([1, 2, 3, None]), s) for s in rng.sample(range(100), 60)]
    row = lambda key, who, seq: {"professor_id": who, "author_id": "A", "seq": seq, "id": key, "title": f"{key} as of {seq}", "authorships": [{"author": {"id": "A"}, "author_position": f"p{seq}"}]}
    folder, seen = tmp_path / "in", f"file://{tmp_path}/seen"
    os.makedirs(folder)
    for part in range(4):
        some = lines[15 * part : 15 * part + 15] + (lines[:3] if part == 3 else [])
        (folder / f"{part}.json").write_text("".join(json.dumps(row(*x)) + "\n" for x in some) + "not json\n")
        ingest.ingest(ctx, str(folder), seen).awaitTermination()
    titles = {k: max(s for key, _, s in lines if key == k) for k in {key for key, _, _ in lines}}
    assert {r["external_id"]: r["title"] for r in ctx.table("works").collect()} == {k: f"{k} as of {s}" for k, s in titles.items()}
    ids = {r["work_id"]: r["external_id"] for r in ctx.table("works").collect()}
    links = {}
    for key, who, seq in lines:
        if who is not None:
            links[who, key] = max(seq, links.get((who, key), -1))
    assert {(r["professor_id"], ids[r["work_id"]]): r["authorship_position"] for r in ctx.table("links").collect()} == {k: f"p{s}" for k, s in links.items()}
    # a stale arrival alone writes nothing
    versions = ctx.store.versions("works")
    old = min(lines, key=lambda x: x[2])
    (folder / "9.json").write_text(json.dumps(row(old[0], old[1], -5)) + "\n")
    ingest.ingest(ctx, str(folder), seen).awaitTermination()
    assert ctx.store.versions("works") == versions


# -- store


def test_store_snapshots(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert not s.exists("t") and s.read("t", "a int").count() == 0
    with pytest.raises(LookupError):
        s.read("t")
    s.write("t", spark.range(3))
    s.write("t", s.read("t").where("id > 0"))
    assert sorted(r[0] for r in s.read("t").collect()) == [1, 2]
    ro = store.Store(spark, s.path, read_only=True)
    for f in (lambda: ro.write("t", spark.range(1)), lambda: ro.put_state("x", status="y")):
        with pytest.raises(PermissionError):
            f()


def bytes_of(path, folder):
    return sum(f.stat().st_size for f in (path / "data" / folder).rglob("*.parquet"))


def test_an_upsert_writes_what_it_changes(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    body = lambda df, x: df.select("id", F.sha2(F.concat("id", F.lit(x)).cast("string"), 256).alias("body"), F.lit(x).alias("mark"))
    assert s.write("t", body(spark.range(50_000), "old"), key=["id"]) == 50_000
    base = s.version("t").base
    changed = body(spark.range(50_000).where("id % 100 = 7").unionByName(spark.range(50_000, 50_010)), "new")
    assert s.merge("t", changed, ["id"]) == 510
    v = s.version("t")
    assert v.base == base and len(v.deltas) == 1
    assert bytes_of(tmp_path / "s/t", v.deltas[0].folder) < 0.05 * bytes_of(tmp_path / "s/t", base.folder)
    assert s.read("t").groupBy("mark").count().collect() in ([("old", 49_500), ("new", 510)], [("new", 510), ("old", 49_500)])
    # again, keeping a column, and with rows that go
    assert s.merge("t", body(spark.range(5, 9), "newer"), ["id"], keep=["mark"], gone=spark.range(3)) == 7
    got = {r["id"]: r for r in s.read("t").where("id < 10").collect()}
    assert sorted(got) == list(range(3, 10)) and {k: r["mark"] for k, r in got.items()} == {k: "new" if k == 7 else "old" for k in got}
    assert [r["mark"] for r in s.read("t", number=1).where("id < 3").collect()] == ["old"] * 3
    before = sorted(map(tuple, s.read("t").collect()))
    s.compact("t")
    v = s.version("t")
    assert not v.deltas and v.base.buckets and sorted(map(tuple, s.read("t").collect())) == before and s.rows("t") == len(before) == v.base.rows
    assert s.expire("t", 1, 0) == 3 and s.versions("t") == [v.number] and sorted(map(tuple, s.read("t").collect())) == before


def test_a_lookup_reads_what_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 1000)
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.write("t", spark.range(8000).withColumn("x", F.col("id") * 2))
    s.merge("t", spark.range(9000, 13_000).withColumn("x", F.lit(-1)), ["id"])  # so many that a new base is made
    assert s.version("t").base.buckets == 12 and not s.version("t").deltas
    s.merge("t", spark.createDataFrame([(5, 99)], "id bigint, x bigint"), ["id"])
    keys = spark.createDataFrame([(5,), (6,), (8500,)], "id int")
    found = s.get("t", keys)
    assert sorted(map(tuple, found.collect())) == [(5, 99), (6, 12)]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "_bucket#" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [In(id" in plan
    assert s.get("t", keys.limit(0)).count() == 0
    monkeypatch.setattr(store, "LOOKUP_KEYS", 2)
    assert sorted(map(tuple, s.get("t", keys).collect())) == [(5, 99), (6, 12)]


def test_null_keys_and_new_columns(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.merge("t", spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string"), ["k"])
    s.merge("t", spark.createDataFrame([(None, "c", 1.5), (2, "d", None)], "k int, x string, y double"), ["k"])
    assert sorted(map(tuple, s.read("t").collect()), key=str) == [(1, "a", None), (2, "d", None), (None, "c", 1.5)]
    assert s.merge("t", s.read("t").where("k = 77"), ["k"]) == 0 and s.merge("none", None, ["k"], gone=spark.range(1)) == 0
    s.write("e", spark.range(0), key=["id"])
    s.compact("e")
    assert s.read("e").count() == 0


def test_two_writers_lose_nothing(spark, tmp_path):
    where = f"file://{tmp_path}/s"
    one, two = store.Store(spark, where), store.Store(spark, where)
    one.write("t", spark.range(20))
    assert one.read("t").count() == two.read("t").count() == 20
    one.write("t", one.read("t").unionByName(spark.range(100, 110)))
    with pytest.raises(store.Conflict):
        two.write("t", two.read("t").unionByName(spark.range(200, 210)))
    assert two.update("t", lambda t: t.unionByName(spark.range(200, 210))) == 40
    # many at once, by both ways
    writers = [store.Store(spark, where) for _ in range(6)]

    def change(k):
        rows = spark.range(1000 + 10 * k, 1000 + 10 * k + 10)
        return writers[k].merge("t", rows, ["id"]) if k % 2 else writers[k].update("t", lambda t: t.unionByName(rows))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(change, range(6)))
    assert sorted(r[0] for r in one.read("t").collect()) == [*range(20), *range(100, 110), *range(200, 210), *range(1000, 1060)]
    assert one.versions("t") == list(range(1, len(one.versions("t")) + 1))


def test_a_stage_runs_again_after_a_conflict(ctx, spark):
    pipeline.run(ctx, through_stage="scrape")
    other = store.Store(spark, ctx.store.path)
    tries = []

    def stage(ctx):
        rows = ctx.table("candidates")
        tries.append(rows.count())
        if len(tries) == 1:
            other.merge("candidates", other.read("candidates").limit(1).withColumn("candidate_id", F.lit(99)), ["candidate_id"])
        ctx.put("candidates", rows.withColumn("title", F.lit("seen")))
        return {}

    pipeline._staged(ctx, stage)
    assert tries == [3, 4] and ctx.table("candidates").where("title = 'seen'").count() == 4


def test_links_to_other_hosts_are_not_asked(spark, ctx):
    answers = world().answers | {"https://elsewhere.example.com/ann": "<p>ann@elsewhere.example.com</p>"}
    answers[ROSTER] = '<ul><li><a href="https://elsewhere.example.com/ann">Ann Lee</a> Professor of noise</li></ul>'
    asked = fetch.Recorded(answers)
    row = {"source_id": 1, "roster_url": ROSTER, "parser_hint": None, "domain": "example.edu"}
    found = list(pipeline._scrape(asked, row))
    assert [r["name"] for r in found] == ["Ann Lee"] and not any("elsewhere" in u for u in asked.asked)
    assert "outside" in list(pipeline._scrape(asked, row | {"roster_url": "https://elsewhere.example.com/ann"}))[0]["error"]
    moved = fetch.Within(Moved(), {"example.edu"})
    with pytest.raises(ValueError):
        moved.get("https://example.edu/")


class Moved:
    def get(self, url, params=None, body=None):
        return 200, "https://elsewhere.example.com/", ""


def test_tasks_share_the_keys(spark):
    """Two keys: two tasks ask, each with its own key, whatever the rows' partitions."""
    maker = fetch.HttpMaker("test", keys=("", "a", "b", "a"))
    assert maker.shares == 2 and [maker(k, 2).pool.take() for k in range(2)] == ["a", "b"] and fetch.HttpMaker("test").shares == 1
    read = lambda f, row: [{"id": row["id"], "key": f.pool.take(), "task": TaskContext.get().partitionId()}]
    got = fetch.fetch_each(spark.range(64, numPartitions=4), maker, read, "id bigint, key string, task int", maker.shares).collect()
    assert len(got) == 64 and {(r["task"], r["key"]) for r in got} == {(0, "a"), (1, "b")}
    assert len({r["task"] for r in fetch.fetch_each(spark.range(64, numPartitions=4), fetch.HttpMaker("test"), read, "id bigint, key string, task int", 1).collect()}) == 1


def test_embedding_commits_in_parts(ctx, monkeypatch):
    pipeline.run(ctx, through_stage="works")
    monkeypatch.setattr(pipeline, "EMBED_ROWS", 1)
    assert dict(pipeline.run(ctx, "embed", "embed"))["embed"]["works_embedded"] == 3
    assert ctx.store.versions("vectors")[-1] >= 2 and ctx.table("vectors").count() == 3


def test_ids_follow_the_old_ones(spark):
    old = spark.createDataFrame([(7, "z")], "id bigint, k string")
    new = spark.createDataFrame([(c,) for c in "dacb"], "k string").repartition(3)
    assert sorted((r["k"], r["id"]) for r in store.with_ids(new, old, "id", ["k"]).collect()) == [("a", 8), ("b", 9), ("c", 10), ("d", 11)]


def test_two_keys(spark):
    old = spark.createDataFrame([(1, 1, "u1", "ann"), (2, 1, None, "bob")], "id bigint, s int, u string, n string")
    new = spark.createDataFrame([(1, "u1", "renamed"), (1, None, "bob"), (1, "u9", "cid"), (2, "u1", "ann")], "s int, u string, n string")
    out = {(r["s"], r["n"]): r["id"] for r in store.target_ids(new, old, "id", ["s", "u"], ["s", "n"]).collect()}
    assert out == {(1, "renamed"): 1, (1, "bob"): 2, (1, "cid"): None, (2, "ann"): None}


# -- sources and settings


def test_key_pool_and_limits():
    now = [0.0]
    pool = fetch.KeyPool(["a", "b", "a", ""], clock=lambda: now[0])
    assert [pool.take() for _ in range(3)] == ["a", "b", "a"]
    pool.rest("b", 5)
    pool.rest("a", 9)
    assert pool.take() is None and pool.wait_seconds() == 5
    now[0] = 6
    assert pool.take() == "b"
    slept = []
    limiter = fetch.Limiter(2, clock=lambda: now[0], sleep=slept.append)
    limiter.wait()
    limiter.wait()
    assert slept == [2.0]
    assert fetch.pause("3", 1) == 3 and fetch.pause("x", 3) == 8 and fetch.pause(None, 9) == 60
    assert fetch.allowed("https://a.b.edu/x", {"b.edu"}) and not fetch.allowed("https://ab.edu", {"b.edu"})
    with pytest.raises(ValueError):
        fetch.Http("x", domains={"b.edu"}).get("https://evil.example")


def test_requests_that_fail_are_made_again(monkeypatch):
    import io
    import urllib.error

    slept, asked = [], []
    monkeypatch.setattr(fetch.time, "sleep", slept.append)

    def answering(*found):
        left = list(found)

        def once(self, request):
            asked.append(request.full_url)
            x = left.pop(0) if len(left) > 1 else left[0]
            if isinstance(x, Exception):
                raise x
            return x

        monkeypatch.setattr(fetch.Http, "_once", once)

    refused = lambda after=None: urllib.error.HTTPError("u", 429, "", {"retry-after": after} if after else {}, io.BytesIO())
    answering(refused("3"), urllib.error.URLError("down"), (200, "u", "body"))
    assert fetch.Http("x", interval=0).get("https://a/b", {"q": 1}) == (200, "u", "body") and slept == [3.0, 1.0]
    answering(refused())
    with pytest.raises(urllib.error.HTTPError):
        fetch.Http("x", interval=0).get("https://a/b")
    answering(urllib.error.HTTPError("u", 404, "", {}, io.BytesIO()))
    assert fetch.Http("x", interval=0).get("https://a/b")[0] == 404
    asked.clear(), slept.clear()
    answering(refused("9"), (200, "u", "by another key"))
    assert fetch.Http("x", interval=0, keys=["k1", "k2"]).get("https://a/b")[2] == "by another key"
    assert asked == ["https://a/b?api_key=k1", "https://a/b?api_key=k2"] and not slept  # the refused key rests


class Endless:
    def get(self, url, params=None, body=None):
        return 200, url, "x"


def test_a_crawl_without_end_is_an_error():
    follow = lambda page, url: [f"https://a?page={int(url.split('=')[1]) + 1}"]
    with pytest.raises(OSError, match="more than 5 pages"):
        list(fetch.crawl(Endless(), "https://a?page=0", follow, most=5))


def test_fetched_answers_outlive_a_crash(ctx, spark):
    todo = spark.range(6).select(F.col("id").alias("professor_id"))
    asked = spark.sparkContext.accumulator(0)
    schema = "professor_id bigint, payload string"

    def read(f, row, fail):
        if fail and row["professor_id"] == 4:
            raise OSError("the line went dead")
        asked.add(1)
        if row["professor_id"] % 2:
            yield {"professor_id": row["professor_id"], "payload": "p"}

    pipeline.JOURNAL_ROWS, kept = 1, pipeline.JOURNAL_ROWS
    try:
        with pytest.raises(Exception, match="the line went dead"):
            pipeline._fetched(ctx, "match", todo.where("professor_id < 6"), "professor_id", lambda f, r: read(f, r, True), schema).collect()
    finally:
        pipeline.JOURNAL_ROWS = kept
    before = {r[0] for p in ctx.store.folders(f"{ctx.store.path}/journal/match") for r in spark.read.parquet(p).collect()}
    asked.value = 0
    out = pipeline._fetched(ctx, "match", todo, "professor_id", lambda f, r: read(f, r, False), schema).collect()
    assert sorted(r["professor_id"] for r in out) == [1, 3, 5] and asked.value == 6 - len(before) and 4 not in before


def test_paging_stops():
    page = lambda n, count: json.dumps({"results": [{"id": str(k)} for k in range(n)], "meta": {"count": count}})
    f = fetch.Recorded({"https://a/works": page(2, 3)})
    assert len(list(fetch.author_works(f, "https://a", "A", 2021, 2, 5))) == 4 and len(f.asked) == 2
    f = fetch.Recorded({"https://a/works": page(0, 9)})
    assert list(fetch.author_works(f, "https://a", "A", 2021, 2, 5)) == [] and len(f.asked) == 1
    f = fetch.Recorded({"https://n/projects/search": json.dumps({"results": [{}] * 50})})
    assert len(list(fetch.nih_projects(f, "https://n", "Ann Lee", "", 50, 3))) == 150
    f = fetch.Recorded({"https://f/awards.json": json.dumps({"response": {"award": [{"id": "1"}]}})})
    assert [a["id"] for a in fetch.nsf_awards(f, "https://f", "Ann B. Lee", "U", 50, 5)] == ["1"] and "piLastName=Lee" in f.asked[0]


def test_seed(spark, tmp_path):
    file = tmp_path / "s.json"
    file.write_text(json.dumps([{"name": "A", "domain": "a.edu", "departments": [{"department_type": "physics", "roster_url": "https://x.a.edu"}, {"department_type": "astronomy", "roster_url": "https://b.org"}]}, {"name": "B", "domain": "b.edu"}]))
    s = seed.read_seed(spark, str(file))
    assert s.count() == 2 and seed.read_seed(spark, str(file), 1).count() == 1
    assert [r["roster_url"] for r in seed.off_domain(seed.sources(s)).collect()] == ["https://b.org"]
    (tmp_path / "lines").mkdir()
    for k, item in enumerate(json.loads(file.read_text())):
        (tmp_path / "lines" / f"{k}.jsonl").write_text(json.dumps({"pos": k} | item) + "\n")
    both = seed.read_seed(spark, str(tmp_path / "lines"))
    assert sorted(map(str, both.collect())) == sorted(map(str, s.collect())) and seed.read_seed(spark, str(tmp_path / "lines"), 1).first()["name"] == "A"


def test_settings_in_order(tmp_path):
    (tmp_path / "rosterlake.toml").write_text("[matching]\nthreshold = 0.7\n[search]\nwork_limit = 3\n")
    (tmp_path / ".env").write_text("# c\nexport ROSTERLAKE_SEARCH_WORK_LIMIT='4'\nROSTERLAKE_AUTHORS_API_KEYS=a, b\n")
    s = config.load(profile="small", env={"ROSTERLAKE_MATCHING_AMBIGUITY_MARGIN": "0.1", "ROSTERLAKE_SEARCH_RESULT_LIMIT": ""}, folder=str(tmp_path))
    assert (s.matching.threshold, s.matching.ambiguity_margin, s.search.work_limit, s.search.result_limit, s.embeddings.dimension, s.authors.api_keys) == (0.7, 0.1, 4, None, 64, ["a", "b"])
    with pytest.raises(ValueError):
        config.load(profile="none", env={}, folder=str(tmp_path))
    assert any(r["status"] == "fail" for r in cli.doctor(s))


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'Ann "A", Lee', "U", None, "u", "now")], "id int, name string, university string, department string, profile_url string, added_at string")
    export.write_shortlist(rows, f"file://{tmp_path}/out")
    (part,) = tmp_path.glob("out/*.csv")
    assert part.read_text().splitlines() == ["id,name,university,department,profile_url,added_at", '1,"Ann ""A"", Lee",U,,u,now']
    assert export.search_address("/", q="a b", page=None, dept="") == "/?q=a+b"
    assert json.loads(export.as_json(rows.select("id", F.lit(2).alias("n")))) == [{"id": 1, "n": 2}]
