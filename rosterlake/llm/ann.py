"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance: vectors are dealt into ranges of norm, a
vector gets one more coordinate that brings its norm to the greatest norm M of its range,
a query is scaled to M and gets a zero.  So one vector of great norm does not flatten the
distances of all others.  A table hashes with K Gaussian projections, floored at width W;
a query visits its own bucket and perturbed ones in the order of their estimated success,
which is the product over the projections of the chance that a neighbour at the distance
looked for falls into the slot, until the chances add up to ``mass``.  Candidates of all
tables are merged and ranked by exact inner products of the original vectors in double
precision.

Levels.  How far neighbours are is told by a few queries (one in 16, ``PILOTS`` at most),
those of smallest hash, whose k-th neighbour among all vectors is found exactly in one
pass.  The first level looks as far as these need.  A query is done if it has k neighbours and
the k-th is no farther than its level looked, so a level passes on only what lies within;
the others go on to a level that looks farther.  What the last level leaves, queries far from everything, is compared with all
vectors, in blocks.  So each query gets k neighbours wherever there are as many vectors.

Every vector is indexed.  Equal vectors are indexed once with their ``k + 1`` smallest ids,
which is all that a result of k can hold, so a vector that is very common costs what a rare
one does.  A bucket of many vectors or queries is dealt out in blocks of ``ROWS`` by
``ASKED``; many small blocks share a task, which gets one copy of a vector or query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do those that differ in length from the most common length (ties: the
greater), which have no inner product with the rest: a warning tells how many; equal
scores go by the smaller id; of rows that repeat an id the vector of smallest hash
counts; fewer candidates than k give fewer rows; an empty table gives no rows; extra
columns are left out.
"""

from __future__ import annotations

import functools
import itertools
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scope, small_batches

#: Pilots at most and at least; else one in 16 queries.
PILOTS, LEAST_PILOTS = 64, 8
#: Ranges of norm: each spans a factor of 2 ** (1 / 4); the last takes all smaller norms.
RANGES = 16
ROWS, ASKED = 4096, 1024
FOUND = "query_id bigint, rank int, vec_id bigint, score double"
SPOT = ["part", "bucket"]


@dataclass(frozen=True)
class Index:
    """Tables, projections of a table, slot width over the distance looked for, and
    the share of neighbours at that distance that a table's probes should meet."""

    tables: int = 1
    projections: int = 8
    width: float = 2.5  # wide enough for neighbours to lie one slot off at most
    mass: float = 0.9
    seed: int = 17


@dataclass(frozen=True)
class Level:
    """Hashing for neighbours whose inner product with a query of norm one is ``reach`` at
    least.  A range has its greatest norm and the distance looked for; ranges that hold
    no such vector have none."""

    norms: dict[int, float]
    far: dict[int, float]
    reach: float
    a: np.ndarray  # tables x (dimensions + 1) x projections
    b: np.ndarray
    index: Index

    @property
    def spread(self) -> float:
        """The distance looked for, in slots."""
        return 1 / self.index.width

    def slots(self, x: np.ndarray, r: int, query: bool) -> np.ndarray:
        """tables x rows x projections, before flooring, in range r."""
        size, norm = np.sqrt((x * x).sum(axis=1, keepdims=True)), self.norms[r]
        if query:
            x, rest = x * (norm / size), np.zeros((len(x), 1))
        else:
            rest = np.sqrt(np.maximum(0.0, norm**2 - size**2))
        return np.hstack([x, rest]) @ self.a / (self.index.width * self.far[r]) + self.b[:, None, :]


def bucket(slots: np.ndarray) -> np.ndarray:
    """One 64-bit key of each row's whole slot numbers."""
    key = np.zeros(slots.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(slots.shape[-1]):
            key = (key ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


@functools.cache
def offsets(projections: int) -> np.ndarray:
    """All buckets around one, a slot to either side at most."""
    return np.array(list(itertools.product((-1, 0, 1), repeat=projections)), np.int8)


def perturbations(places: np.ndarray, spread: float, mass: float) -> list[np.ndarray]:
    """For each query offsets of buckets to visit, most likely first, until their chances
    sum up to ``mass``.  ``places``: rows x projections, a query's place within its slots."""
    cdf = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))), otypes=[float])
    steps = np.arange(-1, 3)
    below = cdf((steps - places[:, :, None]) / spread)
    logs = np.log(np.maximum(1e-12, np.diff(below, axis=2)))  # rows x projections x 3
    total = logs[:, 0, :]
    for k in range(1, places.shape[1]):
        total = (total[:, :, None] + logs[:, k, None, :]).reshape(len(places), -1)
    order = np.argsort(-total, axis=1, kind="stable")
    summed = np.cumsum(np.exp(np.take_along_axis(total, order, axis=1)), axis=1)
    every = offsets(places.shape[1])
    return [every[o[: int(np.searchsorted(c, mass)) + 1]] for o, c in zip(order, summed, strict=True)]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector, name): rows that take part, an id once; ``name`` is one for equal
    vectors."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).collect()
    if len(lengths) > 1:
        warnings.warn(f"{sum(r['count'] for r in lengths[1:])} vectors of another length than {lengths[0]['n']} take no part", stacklevel=3)
    rows = rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0))
    name = F.struct(F.xxhash64(v).alias("x"), F.xxhash64(F.lit(1), v).alias("y"))
    return rows.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min_by(v, name).alias("vector"), F.min(name).alias("name"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(key, vector, ids, range): each different vector once, by its smallest id, with its
    k + 1 smallest ids and the range of its norm: 0 for the greatest norms."""
    lowest = Window.partitionBy("name").orderBy("vec_id")
    once = rows.withColumn("at", F.row_number().over(lowest)).where(F.col("at") <= k + 1)
    once = once.groupBy("name").agg(F.min_by("vector", "vec_id").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    square = F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    return once.select(F.get("ids", F.lit(0)).alias("key"), "vector", "ids", F.sqrt(square).alias("norm"))


def kth_products(vectors: DataFrame, pilots: np.ndarray, k: int) -> np.ndarray:
    """For each pilot, scaled to norm one, its k-th inner product but one (its own vector's)
    among all vectors, found exactly in one pass; of fewer vectors the least."""
    unit = pilots / np.sqrt((pilots * pilots).sum(axis=1, keepdims=True))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((len(unit), 0), -np.inf)
        for batch in batches:
            if batch.num_rows:
                held = np.hstack([held, unit @ matrix(batch.column(0)).T])
                held = -np.partition(-held, k, axis=1)[:, : k + 1] if held.shape[1] > k + 1 else held
        n = held.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(unit)), n)), pa.array(held.ravel())], names=["pilot", "product"])

    order = Window.partitionBy("pilot").orderBy(F.desc("product"))
    top = vectors.select("vector").mapInArrow(best, "pilot bigint, product double").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    return np.array([r[1] for r in sorted(top.groupBy("pilot").agg(F.min("product")).collect())])


def levels(vectors: DataFrame, asked: DataFrame, k: int, index: Index) -> list[Level]:
    """Two, looking as far as all pilots need, by their spread, and half as far again."""
    norms = {r["range"]: r["norm"] for r in vectors.groupBy("range").agg(F.max("norm").alias("norm")).collect()}
    many = min(PILOTS, max(LEAST_PILOTS, asked.count() // 16))
    rows = asked.orderBy(F.xxhash64("key"), "key").limit(many).select("vector").collect()
    pilots = np.array([r[0] for r in rows], np.float64)
    reach = kth_products(vectors, pilots, k)
    p = index.projections
    rng = np.random.default_rng(index.seed)
    a, b = rng.normal(size=(index.tables, pilots.shape[1] + 1, p)), rng.random((index.tables, p))
    top = norms[min(norms)]
    # a few pilots may all lie near: their spread counts, too, by deviations from the median
    middle = float(np.median(reach))
    last = float(min(reach.min(), middle - 3.7 * np.median(np.abs(reach - middle))))
    wide = last - 1.25 * max(0.0, top - last)  # 1.5 times the distance, in the first range
    out = []
    for t in (last, wide):
        # the range's vectors of that product lie at sqrt(2 M (M - t)); none does where t > M
        far = {r: math.sqrt(max(2 * m * (m - t), 1e-6 * m * m)) for r, m in norms.items() if m >= t}
        out.append(Level(norms, far, t, a, b, index))
    return out


def filed(vectors: DataFrame, level: Level, spark: SparkSession) -> DataFrame:
    """(part, bucket, key) of each vector: a part is a table of a range."""
    shared = spark.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for batch in batches:
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            for r in np.unique(kind).tolist():
                if r in h.far:
                    own = np.flatnonzero(kind == r)
                    found = bucket(np.floor(h.slots(matrix(batch.column(1).take(pa.array(own))), r, query=False)))
                    for t in range(len(found)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r * len(found) + t, np.int32)), pa.array(found[t]), batch.column(0).take(pa.array(own))], names=[*SPOT, "key"])

    return vectors.select("key", "vector", "range").mapInArrow(run, "part int, bucket bigint, key bigint")


def visits(asked: DataFrame, level: Level, spark: SparkSession) -> DataFrame:
    """(part, bucket, key) of the buckets that each query visits."""
    shared = spark.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            for r in h.far:
                slots = h.slots(x, r, query=True)
                base = np.floor(slots)
                for t in range(len(slots)):
                    moves = perturbations(slots[t] - base[t], h.spread, h.index.mass)
                    who, moves = np.repeat(np.arange(len(moves)), [len(m) for m in moves]), np.concatenate(moves)
                    for lo in range(0, len(who), 1 << 16):
                        own = who[lo : lo + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r * len(slots) + t, np.int32)), pa.array(bucket(base[t][own] + moves[lo : lo + (1 << 16)])), pa.array(keys[own])], names=[*SPOT, "key"])

    return asked.select("key", "vector").mapInArrow(run, "part int, bucket bigint, key bigint")


def meet(placed: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, key) of vectors and of queries that meet in a bucket.  A bucket has blocks of
    ``ROWS`` vectors by ``ASKED`` queries, each side told how many the other has.  Spark takes
    the many probes of a query for as large as the query, so sizes do not choose these joins."""
    sizes = placed.groupBy(SPOT).agg(F.count("*").alias("n")).join(probes.groupBy(SPOT).agg(F.count("*").alias("m")).hint("merge"), SPOT)
    sizes = sizes.select(*SPOT, F.ceil(F.col("n") / ROWS).cast("int").alias("rows"), F.ceil(F.col("m") / ASKED).cast("int").alias("cols"))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.xxhash64(*SPOT, "row", "col").alias("block")
    left = placed.join(sizes.hint("merge"), SPOT).withColumn("row", own("rows")).withColumn("col", each("cols")).select(block, "key")
    right = probes.join(sizes.hint("merge"), SPOT).withColumn("col", own("cols")).withColumn("row", each("rows")).select(block, "key")
    return left, right


def ranked(placed: DataFrame, probes: DataFrame, vectors: DataFrame, asked: DataFrame, k: int, scope: Scope) -> DataFrame:
    """(key, vec_id, score) of the best k + 1 vectors that each query meets in each task's
    blocks, of those that score its ``floor`` at least."""
    left, right = meet(placed, probes)
    left, right = scope.table(left, "left"), scope.table(right, "right")
    tasks = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-left.count() // ROWS))
    task = F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int").alias("task")
    # files of keys are far smaller than their rows: by their size these would be broadcast
    left = left.groupBy(task, "key").agg(F.collect_list("block").alias("blocks")).join(vectors.select("key", "vector", "ids").hint("merge"), "key")
    right = right.groupBy(task, "key").agg(F.collect_list("block").alias("blocks")).join(asked.select("key", "vector", "floor").hint("merge"), "key")

    def rank(members: pa.Table, asking: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if members.num_rows and asking.num_rows:
            x, q, floor = matrix(members.column("vector")), matrix(asking.column("vector")), asking.column("floor").to_numpy()
            lists = members.column("ids").combine_chunks()
            ids, first, many = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), np.diff(lists.offsets.to_numpy())
            (m_block, m_row), (q_block, q_row) = _by_block(members), _by_block(asking)
            found_q, found_m = [], []
            for at, lo, hi in _runs(m_block):
                a, b = np.searchsorted(q_block, [at, at], side="left")[0], np.searchsorted(q_block, at, side="right")
                rows = m_row[lo:hi]
                for c in range(a, b, 256):
                    who = q_row[c : min(b, c + 256)]
                    scores, edge = q[who] @ x[rows].T, floor[who][:, None]
                    # where a floor lets many pass, no more than a block's best k + 1 can be of use
                    over = np.flatnonzero((scores >= edge).sum(axis=1) > 4 * (k + 1))
                    if len(over):
                        edge[over] = np.maximum(edge[over], -np.partition(-scores[over], k, axis=1)[:, k : k + 1])
                    # near ties may round otherwise in a block product: keep them for now
                    i, j = np.nonzero((scores >= edge - 1e-12 * (1 + np.abs(edge))) | np.isneginf(edge))
                    found_q.append(who[i])
                    found_m.append(rows[j])
            if found_q:
                pair = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_m)]), axis=1)
                for lo in range(0, pair.shape[1], 1 << 16):
                    i, j = pair[:, lo : lo + (1 << 16)]
                    score = (x[j] * q[i]).sum(axis=1)
                    out_q.append(np.repeat(i, many[j]))
                    out_v.append(ids[np.repeat(first[j], many[j]) + np.arange(many[j].sum()) - np.repeat(np.cumsum(many[j]) - many[j], many[j])])
                    out_s.append(np.repeat(score, many[j]))
        who, vec, score = np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)
        order = np.lexsort([vec, -score, who])
        who, vec, score = who[order], vec[order], score[order]
        begin = np.searchsorted(who, who, side="left") if len(who) else who
        keep = np.arange(len(who)) - begin <= k
        keys = asking.column("key").to_numpy() if asking.num_rows else np.zeros(0, np.int64)
        return pa.table({"key": pa.array(keys[who[keep]] if len(who) else np.zeros(0, np.int64)), "vec_id": pa.array(vec[keep]), "score": pa.array(score[keep])})

    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(rank, "key bigint, vec_id bigint, score double")


def _by_block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in order, and the row of each."""
    lists = rows.column("blocks").combine_chunks()
    block = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(block, kind="stable")
    return block[order], row[order]


def _runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of runs of equal values."""
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, int)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ordered)], strict=True):
        yield int(ordered[lo]), lo, hi


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, index: Index | None = None) -> DataFrame:
    """For each row of ``queries`` the k nearest other rows of ``rows`` that are
    found: query_id, rank from 1, vec_id, score."""
    index, spark = index or Index(), rows.sparkSession
    small_batches(spark)
    scope, kept = Scope(spark), Scope(spark, later=True)
    rows = scope.table(usable(rows), "vectors")
    total = rows.count()
    if not total:
        scope.close()
        return spark.createDataFrame([], FOUND)
    vectors = scope.table(distinct_vectors(rows, k), "distinct")
    (top,) = vectors.agg(F.max("norm")).first()
    ranges = F.least(F.floor(4 * F.log2(F.lit(top) / F.col("norm"))), F.lit(RANGES - 1)).cast("int")
    vectors = vectors.withColumn("range", F.greatest(ranges, F.lit(0)))
    wanted = rows.join(queries.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct(), "vec_id", "left_semi")
    names = rows.groupBy("name").agg(F.min("vec_id").alias("key"))
    wanted = kept.table(wanted.join(names, "name").select("vec_id", "key"), "wanted")
    asked = scope.table(vectors.join(wanted.select("key").distinct(), "key", "left_semi"), "asked")
    found = _searched(vectors, asked, min(k + 1, total), k, index, scope)
    best = kept.table(found, "found") if found is not None else None
    scope.close()
    if best is None:
        return spark.createDataFrame([], FOUND)
    others = F.slice(F.filter("found", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    out = wanted.select(F.col("vec_id").alias("query_id"), "key").join(best, "key").select("query_id", F.posexplode(others).alias("pos", "r"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")


def _searched(vectors: DataFrame, asked: DataFrame, need: int, k: int, index: Index, scope: Scope) -> DataFrame | None:
    """(key, found): the best k + 1 (at, vec_id, score) of each query."""
    spark, done = vectors.sparkSession, None
    if asked.isEmpty():
        return None
    todo, before = asked, None
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    for level in [*levels(vectors, asked, k, index), None]:
        if level is not None:
            placed, probes = filed(vectors, level, spark), visits(todo, level, spark)
        else:  # all vectors in one bucket, that all these queries visit
            one = lambda df: df.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("bucket"), "key")
            placed, probes = one(vectors), one(todo)
        floor = F.lit(float("-inf")) if level is None else level.reach * F.col("norm") - 1e-9 * F.col("norm")
        found = ranked(placed, probes, vectors, todo.withColumn("floor", floor), k, scope)
        found = found.unionByName(before) if before is not None else found
        found = found.groupBy("key", "vec_id").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
        lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
        lists = scope.table(lists.join(asked.select("key", "norm"), "key"), "lists")
        if level is None:
            enough = lists
        else:
            enough = lists.where((F.size("found") >= need) & (F.get("found", F.lit(need - 1))["score"] >= level.reach * F.col("norm")))
        done = enough if done is None else done.unionByName(enough)
        todo = todo.join(enough.select("key"), "key", "left_anti")
        if level is None or todo.isEmpty():
            break
        todo = scope.table(todo, "todo")
        before = lists.join(todo.select("key"), "key", "left_semi").select("key", F.explode("found").alias("f")).select("key", "f.vec_id", "f.score")
    return done.select("key", "found")
