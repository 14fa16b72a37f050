import os
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from rosterlake.llm import quality
from rosterlake.scratch import shared_dir


def test_stages_each_on_its_own_input(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "best-fit packing"]
    (_, clean), (_, exact), (_, near), (_, pack) = corpus_pipeline.STAGES

    good = clean(spark, docs, d)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    of = lambda q: [i in kept for i, v in labels.items() if v == q]
    assert np.mean(of(1)) > 0.95 and np.mean(of(0)) < 0.3

    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    out = exact(spark, docs, d)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {min(g)[1] for g in groups.values()}

    last = pack(spark, docs, d)
    total = last.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= 2048


def test_run_ends_in_sequences(spark, tmp_path):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [n for n in set(os.listdir(folder)) - before if n.startswith("rosterlake-")]
    assert len(left) == 1 and "packing" in left[0]  # the result's own files
    assert {"doc_id", "piece", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0
    assert quality.CUT == 0.7 and corpus_pipeline.ORACLE_SQL is None


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, node int, score double"


def test_odd_documents_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns that
    clash; then no documents at all."""
    good = " ".join(f"The quiet river {i} runs past the old mill and the village green." for i in range(9))
    other = " ".join(f"Every spring {i} the children plant beans in the garden behind the school." for i in range(9))
    rows = [(1, good), (2, good), (2, good), (3, good + " And more."), (None, other), (4, None), (5, ""), (6, "The quiet mill. " * 40_000), (7, None), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, "d", 1, None) for i, t in rows], DOCS)
    bad = [(1000 + i, f"BUY!! NOW!! {i} $$$ CHEAP!! WIN!! $$$ " * 6, "en", "s", 5, None, None, None) for i in range(40)]
    more = [(100 + i, f"{good} {other} {i} {'word' * (i + 1)} " + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", 5, None, None, None) for i in range(40)]
    folder = str(tmp_path)
    docs.unionByName(spark.createDataFrame(bad + more, DOCS)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(1000 + i, 0) for i in range(40)] + [(None, 1), (7, None)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    (_, clean), (_, exact), (_, near), (_, pack) = corpus_pipeline.STAGES
    held = spark.read.parquet(f"{folder}/documents.parquet")
    kept = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in clean(spark, held, folder).where("doc_id IS NULL OR doc_id < 1000").collect()), key=str)
    assert (1, good[:9]) in kept and (None, other[:9]) in kept and (6, "The quiet") in kept
    once = exact(spark, held, folder)
    assert once.columns == held.columns and once.where("doc_id IN (1, 2, 4, 5, 7) OR text IS NULL").count() == 2 and once.where("doc_id = 1 OR doc_id = 4").count() == 2
    left = near(spark, once, folder)
    assert left.columns == held.columns
    few = left.where("doc_id < 10 OR doc_id IS NULL").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in few] == [None, 1, 4, 6] and few[0]["text"] == other
    packed = pack(spark, left, folder)
    assert packed.where("doc_id = 6").agg({"length": "sum"}).first()[0] > 100_000
    out = corpus_pipeline.run(spark, folder)
    assert out.where("doc_id >= 1000").count() == 0 and out.count() > 0
    none = held.where("doc_id < -5")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
