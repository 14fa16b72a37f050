from pyspark.sql import functions as F

from rosterlake.llm import compaction, queries


def test_sharding_query_merges_arrivals(spark, sf, monkeypatch):
    commit, what = compaction.ShardStore._commit, []

    def spy(self, parent, new, schema, kind, *rest):
        version = commit(self, parent, new, schema, kind, *rest)
        what.append((kind, len(self.shards(version)[1])))
        return version

    monkeypatch.setattr(compaction.ShardStore, "_commit", spy)
    out = queries.op3_sharding(spark, sf).collect()
    assert [k for k, _ in what].count("append") == queries.ARRIVALS and what[-1][0] == "compact"
    assert what[-1][1] < max(n for _, n in what)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in docs)


def test_many_arrivals_are_read_once(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", fanout=2)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i, "a") for i in range(100)], "doc_id bigint, text string, _arrival string").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    assert store.append_each(rows.mapInPandas(once, rows.schema), F.col("doc_id") % 4) == 4
    assert seen.value == 100
    assert [sorted({r["doc_id"] % 4 for r in store.read(v).collect()}) for v in range(1, 5)] == [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3]]
    assert store.read().columns == rows.columns and sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.collect()))
    store.compact()
    assert store.vacuum() > 0 and sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.collect()))
    empty = compaction.ShardStore(spark, f"file://{tmp_path}/empty")
    assert empty.append_each(rows.limit(0), F.col("doc_id") % 4) == 1 and empty.read().count() == 0 and empty.read().columns == rows.columns


def test_an_append_reads_no_page(spark, tmp_path, monkeypatch):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(spark.range(5))
    read, names = compaction.ShardStore._read, []
    monkeypatch.setattr(compaction.ShardStore, "_read", lambda self, name: names.append(name) or read(self, name))
    store.append(spark.range(5))
    assert names == ["v0000000001.json"] and store.read().count() == 10
