import re

import pytest

from rosterlake.llm import compaction, queries

DOCS = "doc_id bigint, text string, path string, rows int"


@pytest.fixture
def store(spark, tmp_path):
    return compaction.ShardStore(spark, f"file://{tmp_path}/store", target=60_000, fanout=3)


def arrival(spark, lo, n, parts=2):
    return spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i} " * (i % 50), "p", 1) for i in range(lo, lo + n)], DOCS).repartition(parts)


def content(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)


def test_merging_keeps_all_rows(spark, store):
    for k in range(5):
        store.append(arrival(spark, 300 * k, 300))
    store.append(arrival(spark, 0, 10))  # rows that repeat
    before, many = content(store.read()), len(store.shards()[1])
    assert len(before) == 1510
    store.compact()
    version, live, _ = store.shards()
    assert len(live) < many and not store.tiers(live)
    assert content(store.read()) == before
    assert sum(s.rows for s in live) == 1510 and all(s.bytes < 2 * store.target for s in live)
    assert content(store.read(6)) == before  # the version before merging
    assert store.vacuum() > 0
    assert store.versions() == [version] and content(store.read()) == before


def test_tiers_hold_similar_sizes(store):
    shards = [compaction.Shard(str(i), b, 1, "") for i, b in enumerate([100, 110, 120, 5_000, 5_500, 40_000, 90_000])]
    assert [[s.bytes for s in g] for g in store.tiers(shards)] == [[100, 110, 120]]


def test_versions_are_committed_once(spark, store):
    store.append(arrival(spark, 0, 5))
    with pytest.raises(compaction.Conflict):
        store._commit(0, [], None, "late")
    assert store.versions() == [1] and len(store.read().collect()) == 5


def test_a_writer_that_meets_another_retries(spark, store):
    other = compaction.ShardStore(spark, store.path)
    real, first = store._commit, []

    def late(*a):
        if not first:
            first.append(other.append(arrival(spark, 100, 5)))
        return real(*a)

    store._commit = late
    assert store.append(arrival(spark, 0, 5)) == 2
    assert len(store.read().collect()) == 10


def test_empty_and_different_arrivals(spark, store):
    store.append(spark.createDataFrame([], DOCS))
    assert store.read().columns == ["doc_id", "text", "path", "rows"] and store.read().count() == 0
    store.append(arrival(spark, 0, 5, 1))
    store.append(spark.createDataFrame([(9, "new")], "doc_id bigint, extra string"))
    out = {r["doc_id"]: r for r in store.read().collect()}
    assert len(out) == 6 and out[9]["extra"] == "new" and out[9]["text"] is None


def test_lost_work_is_in_no_version(spark, store):
    store.append(arrival(spark, 0, 5))
    store._write(arrival(spark, 50, 5))  # a job that never commits
    assert store.read().count() == 5
    store.vacuum()
    assert store.read().count() == 5


def test_query_runs_without_python(spark, sf):
    out = queries.op3_sharding(spark, sf)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_a_version_writes_only_pages_that_change(spark, store, monkeypatch):
    monkeypatch.setattr(compaction, "PAGE", 4)
    pages = lambda: {p for p, _ in store._list("manifest") if "/p" in p.rsplit("/manifest", 1)[1]}
    for k in range(3):
        before = pages()
        store.append(arrival(spark, 100 * k, 50))
        assert len(pages() - before) == 1  # two shards, whatever was there
    assert len(store._read("v0000000003.json")["schemas"]) == 1
    held = content(store.read())
    store.compact()
    store.vacuum()
    assert content(store.read()) == held and len(pages()) == len(store._read(f"v{store.versions()[-1]:010d}.json")["pages"])


def test_a_merge_is_bounded(store, monkeypatch):
    monkeypatch.setattr(compaction, "MERGE", 1000)
    group = [compaction.Shard(str(i), 300, 1, "") for i in range(9)]
    assert len(store.share(group)) == 4 and len(store.share([compaction.Shard(str(i), 5000, 1, "") for i in range(9)])) == 3
