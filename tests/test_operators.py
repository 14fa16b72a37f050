import json
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import audit, evaluate, funding, identity, inspect, outreach, resolve, search, searchindex, works
from rosterlake import scratch
from rosterlake.functions import vectors
from rosterlake.plans import catalogue

PEOPLE = "professor_id bigint, university_id bigint, name string, normalized_name string, department_type string, title string, profile_url string, profile_text string, source_snippet string, verification_status string, duplicate_of bigint, duplicate_reason string"
WORKS = "work_id bigint, title string, abstract string, publication_year int, cited_by_count int, doi string, source_name string, topics_json string"


def person(i, **k):
    d = {"professor_id": i, "university_id": 1, "name": f"Person {i}", "normalized_name": f"person {i}", "department_type": "physics", "title": "Professor", "profile_url": None, "profile_text": None, "source_snippet": None, "verification_status": "verified", "duplicate_of": None, "duplicate_reason": None}
    return tuple((d | k).values())


def work(i, title, abstract=None, **k):
    d = {"work_id": i, "title": title, "abstract": abstract, "publication_year": 2024, "cited_by_count": i, "doi": None, "source_name": "Journal", "topics_json": None}
    return tuple((d | k).values())


@pytest.fixture
def corpus(spark):
    def make(people, works_, links, dim=64):
        w = spark.createDataFrame(works_, WORKS)
        body = w.withColumn("body", vectors.embedding_text(F.col("title"), F.col("abstract")))
        return {
            "people": spark.createDataFrame(people, PEOPLE),
            "universities": spark.createDataFrame([(1, "Alpha University"), (2, "Beta Institute")], "university_id bigint, name string"),
            "works": w,
            "links": spark.createDataFrame(links, "professor_id bigint, work_id bigint"),
            "vectors": vectors.hash_embed(body, "work_id", "body", dim),
        }

    return make


def run(spark, t, q, **k):
    return search.search(t, spark.createDataFrame([(0, q)], "query_id bigint, query string"), 64, **k)


def test_better_works_rank_first_and_k_limits_the_sum(spark, corpus):
    t = corpus([person(1), person(2), person(3, verification_status="ambiguous"), person(4, duplicate_of=1)], [work(1, "Quantum noise in detectors", "Quantum noise"), work(2, "Plant roots"), work(3, "Quantum noise again"), work(4, "Quantum noise")], [(1, 1), (1, 3), (2, 2), (3, 4), (4, 4)])
    hits, ranked = run(spark, t, "quantum noise")
    rows = hits.orderBy("rank").collect()
    assert [r["professor_id"] for r in rows] == [1, 2] and rows[0]["total_work_count"] == 2 and rows[0]["university_name"] == "Alpha University"
    best = ranked.where("professor_id = 1").orderBy("place").collect()
    one = run(spark, t, "quantum noise", work_limit=1)[0].where("professor_id = 1").first()
    assert one["score"] == pytest.approx(round(best[0]["work_score"], 4)) and one["total_work_count"] == 2
    assert search.work_window(ranked, 1, 1).where("professor_id = 1").first()["work_id"] == best[1]["work_id"]
    assert run(spark, t, "quantum noise", result_limit=1)[0].count() == 1


def test_published_version_stays(spark, corpus):
    t = corpus([person(1)], [work(1, "TiO$_{2}$ Films", "x", source_name="arXiv"), work(2, "TiO<sub>2</sub> films", "x"), work(3, "Other title"), work(4, "", "no title"), work(5, "", "none either")], [(1, i) for i in range(1, 6)])
    _, ranked = run(spark, t, "films")
    assert {r["work_id"] for r in ranked.collect()} == {2, 3, 4, 5}


def test_works_without_a_vector_are_skipped(spark, corpus):
    t = corpus([person(1)], [work(1, "A b"), work(2, "C d")], [(1, 1), (1, 2)])
    t["vectors"] = t["vectors"].where("work_id = 1").unionByName(spark.createDataFrame([(2, [])], "work_id bigint, embedding array<double>"))
    assert run(spark, t, "a b")[0].first()["total_work_count"] == 1


def test_ties_go_to_the_smaller_id_and_facets_filter_after(spark, corpus):
    t = corpus([person(2), person(1, department_type="astronomy")], [work(1, "Same")], [(2, 1), (1, 1)])
    hits, _ = run(spark, t, "same", result_limit=1)
    assert [r["professor_id"] for r in hits.collect()] == [1]
    assert search.facets(hits, t["people"], department_type="physics").count() == 0


def test_a_large_batch_goes_in_parts(spark, corpus, monkeypatch):
    t = corpus([person(i) for i in range(1, 5)], [work(i, f"Topic {'abcd'[i - 1]}x words", "some words here") for i in range(1, 5)], [(i, i) for i in range(1, 5)])
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["topic ax", "bx words", "words here", "", "dx"])], "query_id bigint, query string")
    whole = sorted(map(tuple, search.search(t, asked, 64)[0].collect()))
    monkeypatch.setattr(search, "QUERY_BATCH", 2)
    assert sorted(map(tuple, search.search(t, asked, 64)[0].collect())) == whole and len({r[0] for r in whole}) == 5
    assert search.search(t, asked.where("query_id > 9"), 64)[0].count() == 0


def library(corpus, people=150, per=8, seed=4, prolific=True):
    """People with works of a few topics; titles repeat, as preprints and published."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("quant", "noise", "plasma", "lattice", "orbit", "spin") for b in ("a", "ix", "or", "um", "ics")]
    works_, links = [], []
    for k in range(people * per // 2):
        topic = rng.sample(words, 4)
        title = " ".join(rng.choice(topic) for _ in range(3)) if k % 7 else f"Shared title {k % 3}"
        works_.append(work(k, title, " ".join(rng.choice(topic + words) for _ in range(30)), source_name="arXiv" if k % 5 == 0 else "Journal"))
        links += [(p, k) for p in rng.sample(range(people), 2)]
    links += [(3, k) for k in range(0, len(works_), 3) if prolific]  # one of very many works
    t = corpus([person(i, verification_status="verified" if i % 9 else "excluded", university_id=1 + i % 3) for i in range(people)], works_, links)
    asked = [" ".join(rng.sample(words, n)) for n in (1, 2, 3, 4)] + ["shared title", "", "zzz unknown", "of a", works_[5][1]]
    return t, list(enumerate(asked))


@pytest.mark.parametrize("limit", [1, 10])
def test_an_index_gives_the_same_hits(spark, corpus, monkeypatch, limit):
    t, asked = library(corpus)
    monkeypatch.setattr(searchindex, "ROW_WORKS", 40)
    monkeypatch.setattr(searchindex, "QUERY_BATCH", 4)
    monkeypatch.setattr(searchindex, "AT_ONCE", 300)
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    prepared, profiles = (df.cache() for df in search.index(t))
    assert profiles.where("parts > 1").count() > 1
    want, ranked = search.search(t, queries, 64, limit)
    got, some = search.search(t | {"prepared": prepared, "profiles": profiles}, queries, 64, limit)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    best = want.select("query_id", "professor_id")
    both = [sorted(map(str, r.join(best, ["query_id", "professor_id"], "left_semi").collect())) for r in (ranked, some)]
    assert both[0] == both[1]


def shuffled(spark, run) -> int:
    """Rows that the shuffles of a run write."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for found in [stages()] for i in range(found.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def batch_of(spark, asked):
    return spark.createDataFrame([(k, asked[k % len(asked)][1]) for k in range(60)], "query_id bigint, query string")


@pytest.mark.parametrize("limit", [1, 10, None])
def test_hits_of_people_equal_those_of_ranked_works(spark, corpus, monkeypatch, limit):
    """Whatever a task holds at once, and where a prolific person's works lie in parts."""
    t, asked = library(corpus)
    monkeypatch.setattr(searchindex, "ROW_WORKS", 40)
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    for scores in (50, 1 << 18):
        monkeypatch.setattr(search, "SCORES", scores)
        hits, ranked = search.search(t, queries, 64, limit, 3)
        want = search.rank_people(ranked, t["people"], t["universities"], limit, 3)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    assert hits.count()


def test_a_batch_shuffles_no_row_for_each_query_and_work(spark, corpus):
    t, asked = library(corpus)
    hits = search.search(t, batch_of(spark, asked), 64, 5)[0]
    assert shuffled(spark, hits.collect) < 60 * t["works"].count() / 2


def test_a_summary_shuffles_no_row_for_each_query_and_work(spark, corpus):
    t, asked = library(corpus)
    q = batch_of(spark, asked).select("query_id", "query", F.lit("").alias("notes"), F.array(F.lit("p")).alias("expected_professors"), F.array().cast("array<string>").alias("expected_universities"), F.lit(None).cast("int").alias("minimum_professor_matches"), F.lit(None).cast("int").alias("minimum_university_matches"))
    out = []
    assert shuffled(spark, lambda: out.append(evaluate.summarize(evaluate.evaluate(q, search.search(t, q, 64, 5)[0])).first())) < 60 * t["works"].count() / 2
    assert out[0]["total_queries"] == 60


def test_people_of_one_name_meet_in_the_last_join_only(spark, monkeypatch):
    """Many people of few names: the pairs go through no shuffle."""
    people = spark.range(900).select(F.col("id").alias("professor_id"), F.lit(1).alias("university_id"), F.concat(F.lit("Ann "), F.element_at(F.array(*map(F.lit, ("Lee", "Leed", "Wu"))), (F.col("id") % 3 + 1).cast("int"))).alias("name"))
    monkeypatch.setattr(identity, "BLOCK", 50, raising=False)
    for least in (0.9, 1.0):
        out = []
        assert shuffled(spark, lambda least=least, out=out: out.extend(identity.similar_people(people, least).collect())) < 100_000
        alike = {(0, 1), (1, 0)} if least < 1 else set()  # "ann lee" and "ann leed"
        want = {(a, b) for a in range(900) for b in range(a + 1, 900) if a % 3 == b % 3 or (a % 3, b % 3) in alike}
        assert len(out) == len(want) and {(r["a"], r["b"]) for r in out} == want


def test_components_shuffle_no_row_for_each_word(spark):
    """Rows of one key count together, a null key too, and what adds up to zero has no row."""
    rng = random.Random(1)
    texts = [(None if k % 40 == 0 else k % 30 * 10, " ".join(rng.choice(["Ähre", "x", f"w{k}", "noise\u00a0of", "\t"]) for _ in range(50))) for k in range(200)] + [(1, None), (2, ""), (3, "one one")]
    rows, out = spark.createDataFrame(texts, "k bigint, t string").repartition(3), []
    rows = rows.localCheckpoint()
    assert shuffled(spark, lambda: out.extend(vectors.hash_components(rows, "k", "t", 64).collect())) <= len(texts)
    want: dict = {}
    for k, t in texts:
        if t:
            sums = vectors._hash_embed_texts([t], 64)[0]
            count = vectors.hash_sums(pa.array(t.lower().split()), np.zeros(len(t.split()), np.int64), 1, 64)[0]
            assert np.allclose(sums * np.sqrt((count * count).sum()), count)
            want[k] = want.get(k, 0) + count
    assert {(r["k"], r["bucket"]): r["value"] for r in out} == {(k, b): v for k, x in want.items() for b, v in enumerate(x.tolist()) if v}
    assert len(out) == len({(r["k"], r["bucket"]) for r in out})


def test_an_evaluation_searches_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    found = spark.createDataFrame([(0, "Ann Lee", "Alpha"), (1, "Bob", "Beta")], "query_id bigint, professor_name string, university_name string")
    q = spark.createDataFrame([(0, "q", "", ["lee"], ["alpha"], None, None), (1, "r", "", ["ann"], [], None, None)], evaluate.EXPECTED)
    out = evaluate.evaluate(q, found.mapInArrow(seen, found.schema)).collect()
    assert {r["query_id"]: r["hit_at_k"] for r in out} == {0: True, 1: False} and runs.value == 2


def test_an_index_for_a_batch_takes_less_than_twice_the_texts(spark, sf):
    """What the query leaves in the shared folder and among checkpoints."""
    tops = {Path(x.removeprefix("file:")) for x in (scratch.shared_dir(spark), spark.sparkContext._jsc.sc().getCheckpointDir().get())}
    size = lambda: sum(p.stat().st_size for top in tops for p in top.rglob("*") if p.is_file())
    before = size()
    assert catalogue.queries()["search_people_indexed"](spark, sf).count()
    assert size() - before < 2 * Path(sf, "documents.parquet").stat().st_size


def test_an_index_spares_scoring(spark, corpus):
    """Works scored for a query: of people who may be among the best five, not of all."""
    t, asked = library(corpus, 400, prolific=False)
    asked = [a for a in asked if a[1] and "unknown" not in a[1] and "of a" not in a[1]]
    ready = search.query_rows(spark.createDataFrame(asked, "query_id bigint, query string"), 64)
    _, profiles = search.index(t)
    found = searchindex.candidates(profiles, search.searchable(t["people"]), ready, 5)
    scored = t["links"].join(found, "professor_id").select("query_id", "work_id").distinct().count()
    linked = t["links"].select("work_id").distinct().count() * len(asked)
    assert scored < 0.2 * linked, (scored, linked)


def test_bounds_hold(spark, corpus):
    t, asked = library(corpus, 30)
    ready = search.query_rows(spark.createDataFrame(asked, "query_id bigint, query string"), 64)
    prepared, profiles = search.index(t)
    exact = {(r["query_id"], r["work_id"]): r["work_score"] for r in search.score_works(prepared, ready).collect()}
    q = searchindex.Asked.of(ready.withColumn("hashes", F.transform("query_tokens", lambda x: F.xxhash64(x))).orderBy("query_id").collect())
    terms = lambda c: F.transform(F.filter(F.array_distinct(c), lambda x: F.char_length(x) > 2), lambda x: F.xxhash64(x))
    rows = prepared.select("work_id", terms("title_tokens").alias("a"), terms("abstract_tokens").alias("b")).join(searchindex.sketches(prepared), "work_id").toArrow().combine_chunks()
    one = lambda c: rows.column(c).combine_chunks() if rows.num_rows else rows.column(c)
    low, high = searchindex.work_bounds(one("a"), one("b"), one("code"), one("step").to_numpy(), one("off").to_numpy(), q)
    for j, w in enumerate(rows.column("work_id").to_pylist()):
        for i, query in enumerate(q.ids.tolist()):
            assert low[i, j] - 1e-9 <= exact[query, w] <= high[i, j] + 1e-9
    assert (high - low).mean() < 0.06


def test_an_encoder_embeds_the_query_too(spark, corpus):
    """Stored vectors of an encoder: a hashed query would meet them by chance."""
    make = lambda: lambda texts: [[float("noise" in x), float("plant" in x), 0.01] for x in texts]
    t = corpus([person(1), person(2)], [work(1, "Plant roots"), work(2, "Colored noise spectra")], [(1, 1), (2, 2)])
    body = t["works"].withColumn("body", F.lower("title"))
    t["vectors"] = vectors.dense_embed(body, "work_id", "body", make, 3).withColumn("backend", F.lit("mine"))
    hits = search.search(t, spark.createDataFrame([(0, "plants of noise xx")], "query_id bigint, query string").where("1 = 1"), 3, backend="mine", encoders={"mine": make})[0]
    scores = {r["professor_id"]: r["score"] for r in hits.collect()}
    assert scores[1] > 0.4 and scores[2] > 0.4
    assert search.search(t, spark.createDataFrame([(0, "noise")], "query_id bigint, query string"), 3)[0].count() == 0  # none was made by hash
    with pytest.raises(ValueError):
        vectors.encoder("none")
    assert vectors.encoder("math:sqrt")(4.0) == 2.0


def test_scores_equal_the_columns_of_one_work(spark, corpus):
    """The matrix form against the functions of one work and one query."""
    from rosterlake.functions import scoring, text

    t = corpus([person(1)], [work(1, "Quantum noise in detectors", "noise of quantum detectors and noise"), work(2, "", None), work(3, "the noise", "quantum noise again")], [(1, i) for i in (1, 2, 3)])
    prepared = search.prepare_works(t["works"], t["vectors"]).withColumn("embedding", F.when(F.col("work_id") == 3, F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    ready = search.query_rows(spark.createDataFrame([(0, "quantum noise"), (1, "noise"), (2, "of"), (3, "noise quantum noise")], "query_id bigint, query string"), 64)
    got = {(r["query_id"], r["work_id"]): r["work_score"] for r in search.score_works(prepared, ready).collect()}
    q, w = F.col("query_tokens"), [F.col("title_tokens"), F.col("abstract_tokens")]
    one = scoring.work_score(vectors.cosine(F.col("embedding"), F.col("query_vector")), *[scoring.keyword_overlap(q, x) for x in w], *[scoring.phrase_overlap(q, x) for x in w])
    want = {(r["query_id"], r["work_id"]): r["s"] for r in prepared.crossJoin(ready).select("query_id", "work_id", one.alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vectors_of_a_list_and_of_an_encoder(spark):
    stored = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "work_id bigint, embedding array<double>")
    assert [r[0] for r in vectors.by_ids(stored, [2, 9]).collect()] == [2] and vectors.by_ids(stored, []).count() == 0
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "work_id bigint, text string")
    out = {r[0]: r[1] for r in vectors.dense_embed(rows, "work_id", "text", lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts], 2).collect()}
    assert out[1] == pytest.approx([0.6, 0.8]) and out[2] == [0.0, 0.0]
    with pytest.raises(Exception, match="the encoder gave"):
        vectors.dense_embed(rows, "work_id", "text", lambda: lambda texts: [[1.0] for _ in texts], 2).collect()


# -- identity


def test_same_name(spark):
    rows = [person(1, normalized_name="ann lee"), person(2, normalized_name="ann lee", profile_url="https://x"), person(3, normalized_name="ann lee", university_id=2), person(4, normalized_name="ann lee", verification_status="ambiguous"), person(5, duplicate_of=9, duplicate_reason="same_university_name"), person(6, duplicate_of=9, duplicate_reason="same_author")]
    out = {r["professor_id"]: (r["duplicate_of"], r["duplicate_reason"]) for r in identity.same_name(spark.createDataFrame(rows, PEOPLE)).collect()}
    assert out == {1: (2, "same_university_name"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (9, "same_author")}


MATCHES = "professor_id bigint, author_id string, match_status string, match_score double, evidence string"


def test_same_author_and_reset(spark):
    people = spark.createDataFrame([person(1), person(2), person(3, university_id=2), person(4)], PEOPLE)
    matches = spark.createDataFrame([(1, "A", "matched", 0.9, ""), (2, "A", "matched", 0.95, ""), (3, "A", "matched", 0.99, ""), (4, None, "matched", 1.0, "")], MATCHES)
    p, m = identity.same_author(people, matches)
    assert {r["professor_id"]: r["duplicate_of"] for r in p.collect()} == {1: 2, 2: None, 3: None, 4: None}
    one = m.where("professor_id = 1").first()
    assert one["match_status"] == "duplicate" and json.loads(one["evidence"]) == {"author_id": "A", "duplicate_of": 2, "reason": "same_author"}
    p, m = identity.reset_author_duplicates(p, m)
    assert p.where("duplicate_of is not null").count() == 0
    assert {r["match_status"] for r in m.where("professor_id = 1").collect()} == {"unmatched"}


# -- matching


def author(key, name, place="I1", topic="Physics", years=((2025, 3),)):
    return (key, name, [(place,)], [(topic,)], list(years))


def decide(spark, name, found, department="physics", institution="I1"):
    people = spark.createDataFrame([(1, name, department, institution)], "professor_id bigint, name string, department_type string, institution_id string")
    c = spark.createDataFrame([(1, 0, k, a) for k, a in enumerate(found)], f"professor_id bigint, variant int, pos int, candidate {resolve.CANDIDATE}")
    return resolve.decide(people, resolve.score_candidates(people, resolve.merge_candidates(c))).first()


def test_match_and_evidence(spark):
    r = decide(spark, "Jane Doe", [author("A123", "Jane Doe"), author("A456", "Jane D. Doe", "I9", "Biology", ((2010, 2),))])
    assert (r["match_status"], r["author_id"], r["match_score"], r["runner_up_score"]) == ("matched", "A123", 1.0, 0.5435)
    e = json.loads(r["evidence"])
    assert e["selected"]["candidate_id"] == "A123" and [c["score"] for c in e["candidates"]] == [1.0, 0.5435]


@pytest.mark.parametrize(
    ("found", "status"),
    [([], "unmatched"), ([author("A", "Zed Zulu", "I2")], "unmatched"), ([author("A", "Ernest Moniz"), author("B", "E. J. Moniz")], "matched"), ([author("A", "E. Moniz"), author("B", "E. J. Moniz")], "ambiguous")],
)
def test_decisions(spark, found, status):
    assert decide(spark, "Ernest Moniz", found)["match_status"] == status


def test_single_initials_score(spark):
    assert decide(spark, "Ernest Moniz", [author("A", "E. J. Moniz")])["match_score"] == 0.9395


def test_years_and_nulls(spark):
    c = F.col("c")
    rows = spark.createDataFrame([(author("A", "x", years=y),) for y in ([(None, 3)], [(2024, 0)], [(2023, 1), (2020, 5)], [(2021, 1)], [(1999, 1)])], f"c {resolve.CANDIDATE}")
    assert [r[0] for r in rows.select(resolve.recency_score(c)).collect()] == [0.0, 0.0, 0.7, 0.4, 0.1]


def test_merge_keeps_first_and_null_ids(spark):
    rows = [(1, 1, 0, author("A", "late")), (1, 0, 0, author("A", "early")), (1, 0, 1, author(None, "n1")), (1, 0, 2, author(None, "n2")), (1, 1, 1, author("B", "b")), (1, 1, 2, author("C", "c")), (1, 1, 3, author("D", "d"))]
    out = resolve.merge_candidates(spark.createDataFrame(rows, f"professor_id bigint, variant int, pos int, candidate {resolve.CANDIDATE}")).orderBy("pos").collect()
    assert [r["candidate"]["display_name"] for r in out] == ["early", "n1", "n2", "b", "c"]


def test_manual_decision(spark):
    m = spark.createDataFrame([(1, None, "ambiguous", 0.8, ""), (2, "B", "matched", 0.9, "")], MATCHES)
    out = {r["professor_id"]: r for r in resolve.apply_decision(m, 1, "manual_override", "A9", "seen").collect()}
    assert (out[1]["match_status"], out[1]["author_id"], out[1]["match_score"]) == ("manual_override", "A9", 1.0) and out[2]["author_id"] == "B"


# -- works


def test_abstracts(spark):
    df = spark.createDataFrame([({"soft": [0], "matter": [1]},), ({"a": [0, 2], "b": [1, 5]},), ({},), (None,), ({"x": [3], "y": [3]},)], "i map<string,array<int>>")
    got = [r[0] for r in df.select(works.reconstruct_abstract(F.col("i"))).collect()]
    assert got[:4] == ["soft matter", "a b a b", None, None] and got[4] in ("x", "y")


PAYLOAD = f"professor_id bigint, author_id string, seq bigint, {works.WORK}"


def payload(p, a, seq, key, title, position="first", topics=None):
    return (p, a, seq, key, title, {"w": [0]}, 2024, "2024-01-01", None, 3, (("Journal",),), "article", [], topics or [("T", None)], [(("other",), "first", None), ((a,), position, True)])


def test_parsing_and_links(spark):
    df = spark.createDataFrame([payload(1, "A", 0, "W1", "old"), payload(1, "A", 1, "W1", "new", ""), payload(2, "B", 2, "W1", None)], PAYLOAD)
    w = works.parse_works(df.drop("professor_id", "author_id")).collect()
    assert len(w) == 1 and w[0]["title"] == "" and w[0]["source_name"] == "Journal" and json.loads(w[0]["topics_json"]) == [{"display_name": "T"}]
    links = {r["professor_id"]: (r["authorship_position"], r["is_corresponding"]) for r in works.author_links(df).collect()}
    assert links == {1: ("unknown", True), 2: ("first", True)}


def test_what_is_missing(spark):
    people = spark.createDataFrame([person(1), person(2), person(3, verification_status="ambiguous"), person(4, duplicate_of=1), person(5)], PEOPLE)
    matches = spark.createDataFrame([(i, "A", "matched", 1.0, "") for i in (1, 2, 3, 4)] + [(5, "A", "manual_override", 1.0, "")], MATCHES)
    links = spark.createDataFrame([(1, 9)], "professor_id bigint, work_id bigint")
    assert {r[0] for r in works.needs_works(people, matches, links).select("professor_id").collect()} == {2, 5}
    stored = spark.createDataFrame([(1, "hash", 64), (2, "other", 64), (3, "hash", 32)], "work_id bigint, backend string, dimension int")
    assert {r[0] for r in works.needs_embedding(spark.range(1, 5).withColumnRenamed("id", "work_id"), stored, "hash", 64).collect()} == {2, 3, 4}
    with pytest.raises(ValueError):
        works.resume(people, "professor_id", None, -1)
    assert [r[0] for r in works.resume(people, "professor_id", 2, 2).select("professor_id").collect()] == [3, 4]


# -- audit


def audited(spark, people, works_, min_works=15):
    p = spark.createDataFrame(people, PEOPLE)
    w = spark.createDataFrame(works_, WORKS)
    links = w.select(F.lit(1).cast("bigint").alias("professor_id"), "work_id")
    m = spark.createDataFrame([(1, "A", "matched", 1.0, "")], MATCHES)
    u = spark.createDataFrame([(1, "Alpha University")], "university_id bigint, name string")
    return audit.audit_publications(p, u, m, w, links, min_works).collect()


def test_off_topic_works_are_flagged(spark):
    r = audited(spark, [person(1, profile_text="superconducting qubits and cryogenic electronics")], [work(i, f"Tomato harvest {i}", "Soil and water") for i in range(20)])
    assert len(r) == 1 and {"low_profile_alignment", "low_department_alignment"} <= set(r[0]["reasons"])
    assert r[0]["suspicious_score"] == pytest.approx(1.0 + 0.45 + 0.25) and len(r[0]["sample_off_topic_titles"]) == 5


def test_profile_and_duplicates_explain_works(spark):
    on_topic = [work(i, f"Tomato harvest {i}", "Irrigation of tomato fields") for i in range(20)]
    assert audited(spark, [person(1, profile_text="tomato irrigation harvest")], on_topic) == []
    assert audited(spark, [person(1), person(2, duplicate_of=1, profile_text="tomato irrigation harvest")], on_topic) == []
    assert audited(spark, [person(1)], on_topic[:10]) == []


@pytest.mark.parametrize(
    ("values", "score", "reasons"),
    [
        ((20, 0.9, 0.9, 1.0, 0.0, 1), 0.1, []),
        ((20, 0.5, 0.2, 1.0, 0.0, 1), 1.5, ["low_profile_alignment", "low_department_alignment"]),
        ((20, 0.5, None, 1.0, 0.0, 1), 0.85, ["low_department_alignment"]),
        ((20, 0.9, 0.8, 0.5, 0.9, 1), 0.4, ["low_abstract_coverage", "mostly_arxiv"]),
        ((19, 0.1, 0.1, 0.1, 0.9, 35), 1.05, ["high_venue_diversity"]),
    ],
)
def test_suspicion_rules(spark, values, score, reasons):
    row = spark.createDataFrame([values], "total_works int, keyword_share double, profile_alignment_ratio double, abstract_share double, arxiv_share double, distinct_source_count int")
    r = audit.suspicion(row).first()
    assert r["suspicious_score"] == pytest.approx(score) and r["reasons"] == reasons


# -- evaluation, funding, views


def test_evaluation(spark, tmp_path):
    file = tmp_path / "q.json"
    file.write_text(json.dumps([{"query": "a", "expected_professors": ["Ann", "BOB", "Zed"], "minimum_professor_matches": 2}, {"query": "b", "expected_universities": ["none"]}, {"query": "c"}]))
    q = evaluate.load_queries(spark, str(file))
    hits = spark.createDataFrame([(0, "Ann Lee", "U"), (0, "bob ray", "U"), (1, "X", "Somewhere")], "query_id bigint, professor_name string, university_name string")
    out = evaluate.evaluate(q, hits)
    rows = out.orderBy("query_id").collect()
    assert [r["hit_at_k"] for r in rows] == [True, False, None] and rows[0]["missing_professors"] == ["Zed"] and rows[0]["minimum_professor_matches"] == 2
    assert evaluate.summarize(out).first().asDict() == {"total_queries": 3, "labeled_queries": 2, "queries_with_expected_hits": 1, "queries_with_expected_misses": 1, "expected_hit_rate": 0.5}
    assert evaluate.summarize(out.where("query_id = 2")).first()["expected_hit_rate"] is None
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"pos": 1, "query": "b", "expected_universities": ["none"]}\n{"pos": 2, "query": "c"}\n')
    (lines / "b.jsonl").write_text('{"pos": 0, "query": "a", "expected_professors": ["Ann", "BOB", "Zed"], "minimum_professor_matches": 2}\n')
    assert sorted(map(str, evaluate.load_queries(spark, str(lines)).collect())) == sorted(map(str, q.collect()))
    for bad in ("{}", '[{"notes": "x"}]'):
        file.write_text(bad)
        with pytest.raises(ValueError):
            evaluate.load_queries(spark, str(file))


def test_grants(spark):
    nih = spark.createDataFrame([("P1", None, "T", 0.0, 7.0, "2024-01-02T00", "", [("Ann Lee",)]), ("P2", "S2", None, 5.0, None, None, None, [])], funding.NIH)
    got = [tuple(r) for r in funding.parse_nih(nih).collect()]
    assert got == [("nih", "P1", "T", "Ann Lee", 7.0, "2024-01-02", None), ("nih", "S2", "", "", 5.0, None, None)]
    nsf = spark.createDataFrame([("9", "T", 3.0, None, '{"date":"2024-05-06T"}', "2028-05-31", "Ann", "Lee")], funding.NSF)
    assert tuple(funding.parse_nsf(nsf).first()) == ("nsf", "9", "T", "Ann Lee", 3.0, "2024-05-06", "2028-05-31")
    rows = spark.createDataFrame([(1, 500_000.0, "2028-05-31"), (1, 350_000.0, "2020-01-01"), (1, None, None), (2, None, "")], "professor_id bigint, amount double, end_date string")
    out = {r["professor_id"]: (r["total_funding"], r["actively_funded"]) for r in funding.funding_summary(rows, "2026-01-01").collect()}
    assert out == {1: (850_000.0, True), 2: (0.0, False)}


def test_grant_keeps_its_first_person(spark):
    schema = "professor_id bigint, source string, grant_id string, amount double"
    old = spark.createDataFrame([(1, "nih", "G", 1.0)], schema)
    new = spark.createDataFrame([(2, "nih", "G", 5.0, 0), (2, "nsf", "G", 6.0, 0)], schema + ", seq int")
    assert sorted(tuple(r) for r in funding.upsert_grants(old, new).collect()) == [(1, "nih", "G", 5.0), (2, "nsf", "G", 6.0)]


def test_views(spark):
    assert inspect.parse_ids("3, 1,x,3,-2,0,5,7,9") == [3, 1, 5, 7] and inspect.parse_ids(None) == []
    people = spark.createDataFrame([person(1, name="Ann Lee"), person(2, name="Ann Ray"), person(3, duplicate_of=1, duplicate_reason="same_author")], PEOPLE)
    u = spark.createDataFrame([(1, "Alpha University")], "university_id bigint, name string")
    m = spark.createDataFrame([(1, None, "unmatched", None, ""), (2, None, "ambiguous", 0.8, "")], MATCHES)
    assert inspect.resolve_one(people, name="lee") == 1
    for k in ({"name": "ann"}, {"professor_id": 99}):
        with pytest.raises(LookupError):
            inspect.resolve_one(people, **k)
    assert [r["professor_id"] for r in inspect.review_queue(people, u, m).collect()] == [2, 1]
    assert [r["professor_id"] for r in inspect.compare(people, u, m, [2, 1]).collect()] == [2, 1]
    assert inspect.duplicates_of(people, u).first()["canonical_name"] == "Ann Lee"
    assert [r[0] for r in inspect.department_types(people).collect()] == ["physics"]


def test_recent_works(spark):
    w = spark.createDataFrame([work(1, "a", publication_year=None), work(2, "b"), work(3, "c", publication_year=2020), work(4, "d", cited_by_count=None)], WORKS)
    links = w.select(F.lit(1).alias("professor_id"), "work_id")
    assert [r["work_id"] for r in inspect.recent_works(links, w, 4).orderBy("place").collect()] == [4, 2, 3, 1]
    assert [r["work_id"] for r in inspect.recent_works(links, w, 2, by="citations").orderBy("place").collect()] == [2, 4]


def test_outreach(spark, corpus):
    t = corpus([person(1, name="Ann Lee"), person(2)], [work(1, "Old", publication_year=2001), work(2, "Newest", "long " * 400)], [(1, 1), (1, 2)])
    me = outreach.Applicant("quantum noise", "Kim")
    out = outreach.draft(1, me, t, outreach.backend("fake"), papers=1)
    assert "Dear Professor Lee" in out.body and '"Newest"' in out.body and "Kim" in out.body and [w["work_id"] for w in out.works] == [2]
    echo = outreach.draft(1, me, t, outreach.Echo())
    assert "Paper 2 title: Old" in echo.body and "…" in echo.body
    for bad in (2, 77):
        with pytest.raises(LookupError):
            outreach.draft(bad, me, t, outreach.Echo())
    with pytest.raises(ValueError):
        outreach.draft(1, outreach.Applicant(" "), t, outreach.Echo())
    with pytest.raises(ValueError):
        outreach.backend("none")
