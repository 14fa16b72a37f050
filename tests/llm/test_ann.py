import math

import numpy as np
from pyspark.sql import functions as F

from rosterlake.llm import ann, queries

VECTORS = "vec_id bigint, embedding array<double>, name string, bucket int"


def brute(rows, queries, k):
    out = {}
    for q in queries:
        found = sorted((-float(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = by_query(queries.op5_nearest_neighbours(spark, d))
    want = brute(rows, [i for i in rows if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert [s for _, s in found] == sorted([s for _, s in found], reverse=True)
        assert all(abs(s - float(rows[q] @ rows[i])) < 1e-12 for i, s in found)


def test_odd_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0], "n", 1) for i in (0, 3, 5, 20, 21, 22)] + [(40, [0.0, 1.0, 0.0], None, None), (41, [2.0, 0.0, 0.0], None, None), (60, None, None, None), (61, [0.0, 0.0, 0.0], None, None), (62, [math.nan, 1.0, 0.0], None, None), (63, [None, 1.0, 0.0], None, None), (64, [math.inf, 1.0, 0.0], None, None), (65, [1.0, 1.0], None, None), (66, [], None, None), (None, [1.0, 0.0, 0.0], None, None), (3, [1.0, 0.0, 0.0], None, None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = by_query(ann.nearest(df, df.where("vec_id % 20 = 0"), k=3))
    assert set(got) == {0, 20, 40}
    assert got[0] == [(41, 2.0), (3, 1.0), (5, 1.0)] and got[20] == [(41, 2.0), (0, 1.0), (3, 1.0)]


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], None, None)], VECTORS)
    assert ann.nearest(one, one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], None, None), (1, [-1.0, 0.5], None, None)], VECTORS)
    assert by_query(ann.nearest(two, two, k=20)) == {0: [(1, 0.0)], 1: [(0, 0.0)]}
    none = one.where("vec_id > 5")
    assert ann.nearest(none, none).count() == 0


def test_a_common_vector_is_indexed_once(spark):
    df = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double")))).alias("embedding"))
    got = by_query(ann.nearest(df, df.where("vec_id % 1000 = 1"), k=5))
    for q, found in got.items():
        if q % 3:
            assert [i for i, s in found if s == 1.0][:4] == [i for i in range(9) if i % 3 and i != q][:4] or all(s >= 1.0 - 1e-9 for _, s in found)


def test_perturbations_come_by_chance_and_add_up():
    place = np.array([0.1, 0.9, 0.5])
    (moves,) = ann.perturbations(place[None], 0.6, 0.9)
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    chance = lambda m: math.prod(cdf((s + 1 - x) / 0.6) - cdf((s - x) / 0.6) for x, s in zip(place, m, strict=True))
    values = [chance(m) for m in moves.tolist()]
    assert len({tuple(m) for m in moves.tolist()}) == len(moves) and values == sorted(values, reverse=True)
    assert 0.9 <= sum(values) < 0.9 + values[-1]
    assert len(ann.perturbations(np.full((1, 2), 0.5), 0.6, 2.0)[0]) == 9  # all there are


def test_norms_become_distances(spark):
    """The longest vectors win an inner product whatever their direction's share."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)) * rng.uniform(0.2, 3.0, (400, 1))
    df = spark.createDataFrame([(i, v.tolist(), None, None) for i, v in enumerate(x)], VECTORS)
    got = by_query(ann.nearest(df, df.where("vec_id % 40 = 0"), k=10))
    want = brute(dict(enumerate(x)), list(got), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def met(spark, x, queries, monkeypatch, k=20):
    """Results, and the share of all pairs of a query and a vector that were compared."""
    compared, meet = [], ann.meet

    def counting(placed, probes):
        left, right = meet(placed, probes)
        per = left.groupBy("block").count().join(right.groupBy("block").agg({"*": "count"}), "block")
        compared.append(per.selectExpr("sum(`count` * `count(1)`)").first()[0] or 0)
        return left, right

    monkeypatch.setattr(ann, "meet", counting)
    df = spark.createDataFrame([(i, v.tolist(), None, None) for i, v in enumerate(x)], VECTORS)
    got = by_query(ann.nearest(df, df.where(F.col("vec_id").isin(queries)), k=k))
    return got, sum(compared) / len(queries) / len(x)


def recall(x, got, k=20):
    want = brute(dict(enumerate(x)), list(got), k)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / k / len(want)


def test_a_vector_of_great_norm_flattens_nothing(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(400, 16))
    x[7] *= 1000
    queries = list(range(0, 400, 20))
    got, _ = met(spark, x, queries, monkeypatch)
    assert set(got) == set(queries) and all(len(v) == 20 for v in got.values()) and recall(x, got) >= 0.9


def test_a_cluster_and_vectors_far_from_everything(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([np.ones(16) + 0.01 * rng.normal(size=(100, 16)), 3 * rng.normal(size=(300, 16))])
    queries = list(range(0, 400, 20))
    got, _ = met(spark, x, queries, monkeypatch)
    assert set(got) == set(queries) and all(len(v) == 20 for v in got.values()) and recall(x, got) >= 0.9


def test_clustered_vectors_meet_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 24))
    x = (centres[:, None, :] + 0.1 * rng.normal(size=(100, 40, 24))).reshape(-1, 24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, share = met(spark, x, list(range(0, 4000, 40)), monkeypatch)
    assert all(len(v) == 20 for v in got.values()) and recall(x, got) >= 0.9
    assert share < 0.3, share


def test_repeated_ids_count_once_whatever_the_order(spark):
    rows = [(0, [1.0, 0.0], "n", 1), (1, [0.5, 0.5], "n", 1), (1, [0.0, 2.0], "n", 1), (2, [0.3, 0.1], "n", 1)]
    one, other = (by_query(ann.nearest(df, df, k=3)) for df in (spark.createDataFrame(rows, VECTORS), spark.createDataFrame(rows[::-1], VECTORS)))
    assert one == other and all(len(v) == 2 for v in one.values())


def test_probes_are_not_broadcast_however_small_the_queries(spark, monkeypatch):
    """A query has many probes: Spark takes them for as large as the query, and would gather them in the driver."""
    plans, meet, ranked = [], ann.meet, ann.ranked
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def met(placed, probes):
        left, right = meet(placed, probes)
        plans.extend([plan(left), plan(right)])
        return left, right

    def scored(*args):
        found = ranked(*args)
        plans.append(plan(found))
        return found

    monkeypatch.setattr(ann, "meet", met)
    monkeypatch.setattr(ann, "ranked", scored)
    x = np.random.default_rng(4).normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist(), None, None) for i, v in enumerate(x)], VECTORS)
    got = by_query(ann.nearest(df, df.where("vec_id % 20 = 0")))
    assert len(got) == 20 and all(len(v) == 20 for v in got.values()) and recall(x, got) >= 0.9
    assert len(plans) >= 3 and not any("Broadcast" in p for p in plans)
