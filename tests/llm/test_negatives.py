"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import negatives, queries


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    v = {i: (label, [math.floor(256 * float(np.float32(x))) for x in e]) for i, label, e in rows if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for a in filter(is_anchor, v):
        score = lambda i: sum(x * y for x, y in zip(v[a][1], v[i][1]))
        ranked = sorted(((-score(i), i) for i in v if i != a))
        for s, p in [r for r in ranked if v[r[1]][0] == v[a][0]][:positives]:
            hard = [r for r in ranked if v[r[1]][0] != v[a][0] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


SCHEMA = "vec_id bigint, label int, embedding array<float>, home string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)


def clusters(n, dim, many, seed=3):
    rng = np.random.default_rng(seed)
    centres = 4 * rng.normal(size=(many, dim))
    return [(k, int(rng.integers(4)), (centres[k % many] + 0.3 * rng.normal(size=dim)).tolist()) for k in range(n)]


def test_the_query_is_all_pairs(spark, sf):
    rows = [(r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = plain(rows, lambda i: i % 100 == 0)
    assert want and got(queries.op12_hard_negatives(spark, sf)) == want


@pytest.mark.parametrize("blocks", [(2048, 16_384, 256), (3, 40, 2)])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHORS", "ROWS", "AT_ONCE"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rows = clusters(300, 6, 9)
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain(rows, lambda i: i % 10 == 0)


def test_cells_spare_comparisons(spark):
    rows = clusters(2000, 8, 40)
    df = frame(spark, rows)
    plain_rows = negatives.usable(df, 256)
    space = negatives.space_of(plain_rows, 20_000)
    vectors = negatives.filed(plain_rows, space).toPandas()
    anchors = vectors[vectors.vec_id % 100 == 0]
    served = 0
    for home, own in anchors.groupby("home"):
        x = np.stack([np.frombuffer(b, space.kind) for b in own.vector]).astype(float)
        all_x = np.stack([np.frombuffer(b, space.kind) for b in vectors.vector]).astype(float)
        kth = np.sort(x @ all_x.T, axis=1)[:, -30]
        reach = np.sqrt((x * x).sum(axis=1) + space.top - 2 * kth).max()
        d = space.distances(x, query=True)
        b = negatives.Bounds(np.array([0]), d.min(axis=0)[None], d.max(axis=0)[None], np.array([reach]), np.array([home]), np.array([-1]))
        served += len(own) * b.served(0, vectors.cell.to_numpy(), vectors.dist.to_numpy(), vectors.label.to_numpy(), None, False, space.slack).sum()
    assert served < 0.35 * len(anchors) * len(vectors)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_groups_by_cell_or_of_all_cells(spark, monkeypatch, spread):
    """Whatever groups are formed, no more copies are sent than one group of all would get."""
    formed = []
    plain_copies = negatives.copies
    monkeypatch.setattr(negatives, "copies", lambda *a: formed.append(int(plain_copies(*a).sum())) or plain_copies(*a))
    rng = np.random.default_rng(2)
    centres = 4 * rng.normal(size=(8, 12))
    rows = [(k, int(rng.integers(3)), (centres[k % 8] + spread * rng.normal(size=12)).tolist()) for k in range(400)]
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 7 == 0)) == plain(rows, lambda i: i % 7 == 0)
    assert len(formed) > 3 or spread < 1  # where cells spare nothing, anchors of all cells are grouped
    assert formed[-1] <= 400


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(120, 4, 3) + [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (600, 1, None), (700, 2, [nan, 1.0, 1.0, 1.0]), (800, 2, [inf, 1.0, 1.0, 1.0]), (900, 3, [None, 1.0, 1.0, 1.0]), (1000, 1, [0.0] * 4), (1100, 77, [2.0, 1.0, 0.0, 1.0])]
    ties = [(2000 + k, k % 2, [1.5, -0.5, 0.25, 1.0]) for k in range(60)]
    short = [(3000, 1, [1.0, 2.0]), (3001, 1, [])]
    is_anchor = lambda i: i % 100 == 0
    found = got(negatives.mine(frame(spark, rows + ties + short), F.col("vec_id") % 100 == 0))
    assert found == plain(rows + ties, is_anchor)
    repeated = rows + ties + [r for r in rows if r[0] is not None][:50]
    assert got(negatives.mine(frame(spark, repeated), F.col("vec_id") % 100 == 0)) == found


def test_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, (40_000 * rng.normal(size=5)).round().tolist()) for k in range(60)]
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0)) == plain(rows, lambda i: i % 5 == 0)


def test_few_rows(spark):
    assert got(negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0)) == []
    assert got(negatives.mine(frame(spark, [(0, 1, [1.0, 2.0])]), F.col("vec_id") % 100 == 0)) == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.1])]
    assert got(negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0)) == plain(rows, lambda i: i % 100 == 0)
