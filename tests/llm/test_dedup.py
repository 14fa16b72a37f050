import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import common, dedup, graph, queries, simhash
from rosterlake.llm.common import Scope

DOCS = "doc_id bigint, text string, digest string, keep_id int, fp binary"
ROWS = [(3, "a b", "x", 1, None), (1, "ab", "x", 1, None), (2, "a  b", None, None, None), (7, None, None, None, None), (8, " \t\x0b", None, None, None), (9, "", None, None, None), (4, "a b", None, None, None), (4, "a b", None, None, None), (None, "z", None, None, None), (5, "z" , None, None, None), (6, "long " * 40_000, None, None, None)]


def brute(rows):
    groups = defaultdict(list)
    for i, (key, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key is None, key if key is not None else 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        keep = rows[best[3]][0]
        for m in members:
            out.append((rows[m[3]][0], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def test_groups_equal_brute_force(spark):
    out = dedup.groups(spark.createDataFrame(ROWS, DOCS)).collect()
    want, n = brute([r[:2] for r in ROWS])
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in out], key=str) == want
    kept = [r for r in out if r["kept"]]
    assert len(kept) == n and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_keep_one_returns_rows_unchanged(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = dedup.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str)
    assert kept == sorted([(2, "a  b"), (8, " \t\x0b"), (4, "a b"), (5, "z"), (6, "long " * 40_000)], key=str)


def test_frequent_digests_take_the_map_side_path(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 4000).cast("string"))).alias("text"))
    found = dedup.marks(docs)
    top = dedup.frequent(found).collect()
    assert max(r["group_size"] for r in top) == 3000 and len(top) <= dedup.TRACKED
    assert dedup.keep_one(docs).count() == docs.select("text").distinct().count()


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert dedup.groups(none).count() == 0 and dedup.keep_one(none).count() == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    for df in (dedup.groups(docs), dedup.keep_one(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# -- near duplicates


def naive_fingerprint(text, words, distinct=False):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    h = list(set(h)) if distinct else h
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", "  ", "One", "one two", "A b c d e f g", "a B c d e f g", "Ä ä É", "x " * 3000, "a\x0bb c\x1cd", "w" * 20_000]


def test_fingerprints(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCS)
    got = {r["doc_id"]: int.from_bytes(r["fp"], "little") for r in simhash.fingerprints(docs).collect()}
    assert got == {i: naive_fingerprint(t, 3) for i, t in enumerate(TEXTS)}


def test_long_runs_are_counted_in_parts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 200_003, dtype=np.uint64)
    sizes = np.array([0, 3, 140_000, 0, 60_000], np.int64)
    got = simhash.majority(h[:200_003], np.array([0, 3, 140_000, 0, 60_000]))
    at = 0
    for n, g in zip(sizes.tolist(), got.tolist(), strict=True):
        part = h[at : at + n]
        at += n
        assert g == sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def components_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [2, 256])
def test_linking_within_two_bits_loses_nothing(spark, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = [int(b) for b in base]
    for _ in range(220):
        fps.append(fps[rng.integers(len(fps))] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(i, f.to_bytes(8, "little"), 1) for i, f in enumerate(fps)], "node bigint, fp binary, shingles bigint")
    search = simhash.Search()
    made = simhash.plan(nodes, len(fps), search)
    assert sum(t + 1 for _, t in made.parts) == search.radius + 1
    found = {r["node"]: r["component"] for r in graph.components(simhash.links(nodes, made, search, Scope(spark), bucket)).collect()}
    want = components_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_thresholds_follow_the_costs():
    assert simhash.allot([[0, 1, 50], [0, 1, 50], [0, 90, 99]], [[0, 1, 2]] * 3, 2, 2) == [1, 1, 0]
    assert simhash.allot([[0, 60, 70], [0, 60, 200]], [[0, 1, 2]] * 2, 2, 2) == [2, 0]
    with pytest.raises(ValueError):
        simhash.allot([[0, 1]], [[0, 1]], 3, 3)


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (4000, 64)).astype(float)
    for k in range(1, 8):
        bits[:, k * 7] = bits[:, 0]
    groups = simhash.group_bits(bits.T @ bits, 4000, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({0, 7, 14, 21, 28, 35, 42, 49} <= set(g) for g in groups)


def with_buckets(monkeypatch, bucket, block):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda n, p, s, scope: links(n, p, s, scope, bucket, block))


@pytest.mark.parametrize(("bucket", "block"), [(2, 3), (256, 1024)])
def test_near_copies_by_similarity(spark, bucket, block, monkeypatch):
    with_buckets(monkeypatch, bucket, block)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    docs, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(300)]
        docs.append((k, " ".join(base)))
        for edits in (1, 2, 3, 60):  # 60 edits of 300 words leave few shingles
            copy = list(base)
            for at in rng.choice(300, edits, replace=False):
                copy[at] = word()
            docs.append((k + edits, " ".join(copy)))
        k += 100
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {i for i, _ in docs if i % 100 in (0, 60)}


def test_one_rule_for_all_bucket_sizes(spark, monkeypatch):
    """Copies of one text at all similarities: most pairs are about the threshold."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choice(words, 120)
    docs = []
    for i in range(160):
        copy = base.copy()
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            copy[at] = rng.choice(words)
        docs.append((i, " ".join(copy), None, None, None))
    df = spark.createDataFrame(docs, DOCS)
    search = simhash.Search(bits=1024, radius=None)
    of = lambda: {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5, search).collect()}
    whole = of()
    with monkeypatch.context() as m:
        with_buckets(m, 2, 8)
        assert of() == whole


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    text = " ".join(f"t{i}" for i in range(80))
    other = " ".join(f"u{i}" for i in range(80))
    rows = [(3, text), (5, other), (5, text + " more"), (None, other + " end"), (None, "alone and without an id of its own"), (9, other), (9, other)]
    df = spark.createDataFrame([(i, t, "d", None, None) for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(3, text), (5, other), (None, "alone and without an id of its own")], key=str)


def test_near_duplicates_odd_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(None, "some text of its own", None, None, None), (4, "one two", None, None, None)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert len(out) == len(rows) and by[0] == by[1] == by[2] == 0 and by[6] == 5 and by[None] is None
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_hot_keys_are_looked_up_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaabbc")], "k string, i int")
    values = spark.createDataFrame([("a", 1), ("b", 2), ("z", 9)], "k string, v int")
    hot = common.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), "k", 8)
    assert hot == ["a"]
    out = {r["i"]: r["v"] for r in common.looked_up(rows, values, "k", hot).collect()}
    assert out == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: None}


def test_components_of_a_star(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    star = spark.range(1, 300).select(F.lit(0).alias("a"), F.col("id").alias("b")).unionByName(spark.range(300, 400).select((F.col("id") - 100).alias("a"), F.col("id").alias("b")))
    found = {r["node"]: r["component"] for r in graph.components(star).collect()}
    assert found == {i: 0 for i in range(1, 400)}


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (5, 5)], "a bigint, b bigint"))
    found = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert {found[i] for i in range(2, 401)} == {1} and found[1001] == 1000
    assert graph.components(edges.where("a < 0")).count() == 0


def test_simhash_query(spark, sf):
    out = queries.op9_simhash(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert [out.fingerprint[d["doc_id"]] for d in docs] == [f"{naive_fingerprint(d['text'], 3):016x}" for d in docs]
    whole = [int(out.fingerprint[d["doc_id"]], 16) for d in docs]
    want = components_of(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (whole[i] ^ whole[j]).bit_count() <= 2])
    assert [out.component_id[d["doc_id"]] for d in docs] == [docs[w]["doc_id"] for w in want]
