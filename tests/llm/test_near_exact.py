"""The similarity search against components of exact Jaccard similarities."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rosterlake.llm import simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def kept_by_brute_force(texts, similarity=0.8):
    """The ids kept, and the pairs that link, by exact similarities."""
    sets, by = {i: shingles(t) for i, t in texts.items()}, defaultdict(list)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(i, j) for v in by.values() for i in v for j in v if i < j}
    linked = {(i, j) for i, j in pairs if 1e-9 + len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}
    for i, j in linked:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return {i for i in texts if find(i) == i}, linked


@pytest.mark.parametrize(("na", "nb", "common"), [(4, 5, 4), (5, 6, 5), (8, 8, 7), (8, 8, 8), (12, 15, 12), (40, 41, 36)])
def test_chance_of_a_differing_bit(na, nb, common):
    hashes = np.random.default_rng(1).integers(0, 2**64, (4000, na + nb - common), dtype=np.uint64)
    a, b = (simhash.majority(h.ravel(), np.full(4000, h.shape[1])) for h in (hashes[:, :na], hashes[:, na - common :]))
    assert abs(np.bitwise_count(a ^ b).mean() / 64 - simhash.differing(na, nb, common)) < 0.005


def test_texts_of_few_shingles_link_by_their_shingles(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = {}
    # (shingles of one, of the other): the other has words more at its end
    for na, nb in [(4, 5), (5, 6), (6, 7), (12, 15), (30, 37), (4, 6), (6, 8), (9, 12), (30, 38), (100, 125), (100, 126), (200, 250), (200, 251)]:
        for _ in range(12):
            line = [word() for _ in range(nb + 4)]
            texts[len(texts)] = " ".join(line[: na + 4])
            texts[len(texts)] = " ".join(line)
    for _ in range(30):  # 8 and 8 with 7 in common: 0.778
        line = [word() for _ in range(13)]
        texts[len(texts)], texts[len(texts)] = " ".join(line[:12]), " ".join(line[1:])
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    want, _ = kept_by_brute_force(texts)
    assert not want - kept  # nothing is dropped that has no link
    assert len(kept - want) <= 3  # a pair at 0.8 itself may meet in no bucket: under 2 % of the linked


def test_pipeline_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.01").collect()}
    want, linked = kept_by_brute_force(texts)
    assert linked and not want - kept  # nothing is dropped that exact components keep
    assert len(kept - want) <= 0.02 * len(linked)  # the chance that a pair at 0.8 meets in no bucket


def test_recall_by_band_of_similarity(spark):
    """Over sf0.1: pairs just above the threshold share a component, too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r["text"] or "", r["doc_id"])
    sets = {i: shingles(t) for t, i in by_text.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for v in by.values():
        if len(v) < 400:
            for k, i in enumerate(v):
                for j in v[:k]:
                    shared[j, i] += 1
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 5, simhash.Search(bits=1024, radius=None)).collect()}
    bands = defaultdict(lambda: [0, 0])
    for (i, j), n in shared.items():
        similarity = n / (len(sets[i]) + len(sets[j]) - n)
        if similarity >= 0.8 - 1e-9:
            band = bands[min(0.95, int(similarity * 20 + 1e-9) / 20)]
            band[0] += found[i] == found[j]
            band[1] += 1
    print({k: tuple(v) for k, v in sorted(bands.items())})
    assert bands and all(hit >= 0.9 * n for hit, n in bands.values())
