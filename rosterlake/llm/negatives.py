"""Hard negatives by a Voronoi-partitioned join of anchors with all vectors.

Vectors are of whole numbers (components times ``scale``, floored), so inner products are
exact.  The largest inner product becomes the smallest distance: a vector gets one more
coordinate that brings its norm to the greatest norm M of all, an anchor as a query gets a
zero, and their squared distance is ``|a|^2 + M^2 - 2 a.x``.

Pivots cut that space into cells.  Each vector is filed in the cell of its nearest pivot
with its distance to it; anchors are dealt into groups by the pivot nearest to them.  Of a
group it is known how near and how far its anchors are from each pivot, and how far any of
them has to look (its reach).  By the triangle inequality a vector at distance d from the
pivot of its cell can serve a group only if ``nearest - reach <= d <= farthest + reach``;
to such groups, and no others, it is copied.  What a group gets is dealt out in blocks of
``ROWS`` vectors, each joined with the group's anchors by one matrix product; a task gives
only the best few of each anchor, and these are merged.  Where vectors lie so far from each other
that cells spare little, so that groups by cell would be sent more copies than groups of
``ANCHORS`` anchors of all cells, these are formed instead.

Three joins: each anchor with the cell at home, which tells how far the k-th positive is
at most; with the other cells up to that reach; and with the vectors of other labels down
to the least score that a negative of one of its positives may have.  Anchors that find
too few positives at home have no bound and are grouped apart, so they spoil no other's.

Pivots are the means of a few k-means rounds over ``SAMPLE`` vectors of smallest hash; they
only tell what is compared, the result is exact whatever they are.  Everything on the
driver is bounded: the sample, counts by cell, and the bounds of ``AT_ONCE`` groups, which
are broadcast; more groups go in further rounds.

Defined cases: rows with a null id or label, or with a vector that is null, empty or holds
null or non-finite components take no part, nor do those that differ in length from the
most common length (ties: the greater), nor those whose squared norm in units of 1 / scale
is ``LARGEST`` or more, as products might not fit 64 bits.  Zero vectors take part.  Of
rows that repeat an id one counts, that of smallest hash of label and vector.  Ties go to
the smaller id; fewer positives or negatives give fewer rows, down to none; a positive of
score below zero has no negatives; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, small_batches

#: Vectors and Lloyd rounds that pivots are fitted on.
SAMPLE, LLOYD = 4096, 5
#: Anchors of a group and vectors of a block at most; groups whose bounds are broadcast.
ANCHORS, ROWS, AT_ONCE = 2048, 16_384, 256
LARGEST = float(1 << 55)
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
PAIR = "anchor_id bigint, vec_id bigint, score bigint"


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, x, square): rows that take part, an id once."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("double"))
    square = F.aggregate("x", F.lit(0.0).cast("double"), lambda s, x: s + x * x)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("x")).withColumn("square", square).where(F.col("square") < LARGEST)
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.where(F.size("x") == (lengths[0]["n"] if lengths else 0))
    return rows.groupBy("vec_id").agg(F.min_by(F.struct("label", F.col("x").cast("array<bigint>").alias("x"), "square"), F.struct(F.xxhash64("label", "x"), "label")).alias("r")).select("vec_id", "r.*")


@dataclass(frozen=True)
class Space:
    """Pivots in the extended space, the greatest squared norm, and how components of a
    vector are packed."""

    pivots: np.ndarray  # cells x (dimensions + 1)
    top: float
    kind: str

    def unpack(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), -1)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """rows x cells: of vectors, or of anchors as queries, to the pivots."""
        x = x.astype(np.float64)
        own = (x * x).sum(axis=1)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.top - own))
        to = np.hstack([x, rest[:, None]]) @ self.pivots.T
        squares = (own if query else np.full(len(x), self.top))[:, None] + (self.pivots**2).sum(axis=1) - 2 * to
        return np.sqrt(np.maximum(0.0, squares))

    @property
    def slack(self) -> float:
        """More than a distance's rounding error."""
        return 1e-6 * (1 + math.sqrt(self.top))


def space_of(rows: DataFrame, n: int) -> Space:
    top, most = rows.agg(F.max("square"), F.max(F.array_max(F.transform("x", lambda x: F.abs(x))))).first()
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()], np.float64)
    ext = np.hstack([sample, np.sqrt(np.maximum(0.0, top - (sample * sample).sum(axis=1)))[:, None]])
    many = min(len(ext), 256, max(4, math.ceil(math.sqrt(n) / 16)))
    pivots = ext[np.random.default_rng(7).permutation(len(ext))[:many]]
    for _ in range(LLOYD):
        near = (-2 * ext @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
        pivots = np.array([ext[near == k].mean(axis=0) if (near == k).any() else pivots[k] for k in range(many)])
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return Space(pivots, float(top), kind)


FILED = "vec_id bigint, label bigint, vector binary, cell int, dist double, home int"


def filed(rows: DataFrame, space: Space) -> DataFrame:
    """Vectors packed, with cell and distance to its pivot, and ``home``, the cell that is
    nearest to it as an anchor."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            d = s.distances(x, query=False)
            cell = d.argmin(axis=1)
            packed = [row.tobytes() for row in x.astype(s.kind)]
            columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array(s.distances(x, query=True).argmin(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FILED.split(", ")])

    return rows.select("vec_id", "label", "x").mapInArrow(run, FILED)


def grouped(anchors: DataFrame) -> tuple[DataFrame, int]:
    """``anchors`` (with home, reach) and ``group``, and the number of groups: of one home
    each, with a reach or without, and of some ANCHORS members."""
    wide = F.col("reach") == float("inf")
    counts = anchors.groupBy("home", wide.alias("wide")).agg(F.count("*").alias("n")).collect()  # two rows a cell at most
    blocks = {(r["home"], r["wide"]): -(-r["n"] // ANCHORS) for r in counts}
    first, total = {}, 0
    for key in sorted(blocks):
        first[key], total = total, total + blocks[key]
    cells = 1 + max((h for h, _ in blocks), default=0)
    of = lambda held, w: F.get(F.lit([held.get((h, w), 1) for h in range(cells)]), F.col("home"))
    begin, many = (F.when(wide, of(held, True)).otherwise(of(held, False)) for held in (first, blocks))
    return anchors.withColumn("group", (begin + F.pmod(F.xxhash64("vec_id"), many)).cast("int")), total


@dataclass(frozen=True)
class Bounds:
    """Of each group: nearest and farthest anchor to each pivot, reach, home, and which
    labels its anchors may have (by the label's remainder, a bit each)."""

    group: np.ndarray
    near: np.ndarray
    far: np.ndarray
    reach: np.ndarray
    home: np.ndarray
    labels: np.ndarray

    def served(self, k: int, cell: np.ndarray, dist: np.ndarray, label: np.ndarray, at_home: bool | None, same: bool, slack: float) -> np.ndarray:
        """Which vectors may serve the k-th group."""
        reach = self.reach[k] + slack
        ok = (dist <= self.far[k, cell] + reach) & (dist >= self.near[k, cell] - reach)
        if at_home is not None:
            ok &= (cell == self.home[k]) == at_home
        if same:
            ok &= (self.labels[k] >> (label % 63)) & 1 == 1
        return ok


def bounds(anchors: DataFrame, space: Space) -> Bounds:
    shared = anchors.sparkSession.sparkContext.broadcast(space)

    def envelope(members: pa.Table) -> pa.Table:
        s = shared.value
        d = s.distances(s.unpack(members.column("vector")), query=True)
        bits = np.bitwise_or.reduce(np.int64(1) << (members.column("label").to_numpy() % 63))
        return pa.table({"group": members.column("group").slice(0, 1), "near": pa.array([d.min(axis=0)]), "far": pa.array([d.max(axis=0)]), "reach": pa.array([max(members.column("reach").to_pylist())]), "home": members.column("home").slice(0, 1), "labels": pa.array([int(bits)])})

    schema = "group int, near array<double>, far array<double>, reach double, home int, labels bigint"
    rows = anchors.select("group", "vector", "label", "reach", "home").groupBy("group").applyInArrow(envelope, schema).orderBy("group").collect()  # AT_ONCE at most
    return Bounds(*(np.array([r[c] for r in rows]) for c in ("group", "near", "far", "reach", "home", "labels")))


def join(vectors: DataFrame, anchors: DataFrame, groups: int, space: Space, rank, schema: str, at_home: bool | None, same: bool, scope: Scope) -> DataFrame | None:
    """What ``rank(vectors, anchors)`` finds over all blocks of all groups: with the vectors
    at home, or the others, of which it may find some at home again."""
    out = None
    for lo in range(0, groups, AT_ONCE):
        some = anchors.where(F.col("group").between(lo, lo + AT_ONCE - 1)) if groups > AT_ONCE else anchors
        found = _join(vectors, some, space, rank, schema, at_home, same)
        if found is not None:
            found = scope.table(found, "found")
            out = found if out is None else out.unionByName(found)
    return out


def copies(vectors: DataFrame, edge: Bounds, at_home: bool | None, same: bool, slack: float) -> np.ndarray:
    """How many vectors may serve each group."""
    shared = vectors.sparkSession.sparkContext.broadcast(edge)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = np.zeros(len(b.group), np.int64)
        for batch in batches:
            cell, dist, label = (c.to_numpy() for c in batch.columns)
            total += [int(b.served(k, cell, dist, label, at_home, same, slack).sum()) for k in range(len(total))]
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["k", "n"])

    sizes = {r["k"]: r["n"] for r in vectors.select("cell", "dist", "label").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # AT_ONCE at most
    return np.array([sizes.get(k, 0) for k in range(len(edge.group))], np.int64)


def _join(vectors: DataFrame, anchors: DataFrame, space: Space, rank, schema: str, at_home: bool | None, same: bool) -> DataFrame | None:
    edge = bounds(anchors, space)
    sizes = copies(vectors, edge, at_home, same, space.slack)
    if not at_home:
        large = -(-anchors.count() // ANCHORS)
        if sizes.sum() > large * vectors.count():
            anchors = anchors.withColumns({"group": F.pmod(F.xxhash64("vec_id"), F.lit(large)).cast("int"), "home": F.lit(-1)})
            edge = bounds(anchors, space)
            sizes = copies(vectors, edge, at_home, same, space.slack)
    blocks = -(-sizes // ROWS)
    if not blocks.any():
        return None
    shared = vectors.sparkSession.sparkContext.broadcast(edge)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            ids, label, cell, dist = (batch.column(c).to_numpy() for c in (0, 1, 3, 4))
            for k in np.flatnonzero(blocks).tolist():
                own = np.flatnonzero(b.served(k, cell, dist, label, at_home, same, space.slack))
                if len(own):
                    spread = ids[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    block = (spread % np.uint64(blocks[k])).astype(np.int32)
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b.group[k], np.int32)), pa.array(block), *(batch.column(c).take(take) for c in (0, 1, 2))], names=["group", "block", "vec_id", "label", "vector"])

    left = vectors.select("vec_id", "label", "vector", "cell", "dist").mapInArrow(copied, "group int, block int, vec_id bigint, label bigint, vector binary")
    held = dict(zip(edge.group.tolist(), blocks.tolist(), strict=True))
    many = F.get(F.lit([held.get(g, 0) for g in range(int(edge.group[0]), int(edge.group[-1]) + 1)]).cast("array<int>"), F.col("group") - int(edge.group[0]))
    right = anchors.where(many > 0).withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(rank, schema)


def best_of(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest allowed scores of each row; of equal ones the first."""
    if scores.shape[1] > k:
        lost = np.where(ok, -scores, np.iinfo(np.int64).max)
        ok = ok & (lost <= np.partition(lost, k - 1, axis=1)[:, k - 1 : k])
    i, j = np.nonzero(ok)
    order = np.lexsort([j, -scores[i, j], i])
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[keep], j[keep]


def products(a: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products: in doubles while all partial sums are whole there."""
    if top < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


def _blocks(members: pa.Table, asking: pa.Table, space: Space) -> Iterator[tuple]:
    """(ids, labels, anchor rows, scores) of some anchors at a time; ids ascend."""
    if not members.num_rows or not asking.num_rows:
        return
    members = members.sort_by("vec_id")
    ids, labels = members.column("vec_id").to_numpy(), members.column("label").to_numpy()
    x, a = space.unpack(members.column("vector")), space.unpack(asking.column("vector"))
    step = max(1, (1 << 20) // len(x))
    for lo in range(0, len(a), step):
        rows = np.arange(lo, min(len(a), lo + step))
        yield ids, labels, rows, products(a[rows], x, space.top)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """For each anchor (rows for which ``is_anchor``, a condition on vec_id, holds), its
    first ``positives`` other rows of its label and, for each of these, the first
    ``negatives`` rows of another label whose score is ``low`` to ``high`` percent of the
    positive's.  ``rows``: vec_id, label (a whole number), embedding."""
    spark = rows.sparkSession
    small_batches(spark)
    scope, kept = Scope(spark), Scope(spark, later=True)
    plain = scope.table(usable(rows, scale), "whole")
    n = plain.count()
    if not n:
        scope.close()
        return spark.createDataFrame([], MINED)
    space = space_of(plain, n)
    vectors = scope.table(filed(plain, space), "filed")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")

    def nearest(members: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        mine_, own = asking.column("vec_id").to_numpy(), asking.column("label").to_numpy()
        for ids, labels, at, scores in _blocks(members, asking, space):
            i, j = best_of(scores, (own[at][:, None] == labels) & (mine_[at][:, None] != ids), positives)
            for held, found in zip(out, (mine_[at][i], ids[j], scores[i, j]), strict=True):
                held.append(found)
        return pa.table({c: pa.array(np.concatenate(held)) for c, held in zip(("anchor_id", "vec_id", "score"), out, strict=True)})

    def top(found: DataFrame | None) -> DataFrame:
        found = spark.createDataFrame([], PAIR) if found is None else found.distinct()
        return found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)

    square = F.aggregate(F.col("x"), F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    anchors = plain.where(is_anchor).select("vec_id", square.alias("own")).join(vectors.select("vec_id", "label", "vector", "home"), "vec_id")
    anchors = scope.table(anchors.withColumn("reach", F.lit(float("inf"))), "anchors")
    reach = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("own") + space.top - 2 * score.cast("double")))
    asked, groups = grouped(anchors)
    near = join(vectors, asked, groups, space, nearest, PAIR, True, True, scope)
    kth = top(near).where(F.col("at") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("kth"))
    bounded = anchors.join(kth, "vec_id", "left").withColumn("reach", F.when(F.col("kth").isNotNull(), reach(F.col("kth"))).otherwise(float("inf"))).drop("kth")
    asked, groups = grouped(scope.table(bounded, "bounded"))
    far = join(vectors, asked, groups, space, nearest, PAIR, False, True, scope)
    both = far if near is None else near if far is None else near.unionByName(far)
    chosen = top(both).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("at", F.col("vec_id").alias("id"), "score"))).alias("best"))
    least = F.array_min(F.transform(F.filter("best", lambda b: b["score"] >= 0), lambda b: b["score"]))
    ready = anchors.join(chosen, "vec_id").withColumn("least", least).where(F.col("least").isNotNull())
    ready = ready.withColumn("reach", reach(F.col("least") * (low / 100) - 1)).select("vec_id", "label", "vector", "home", "reach", F.transform("best", lambda b: b["id"]).alias("ids"), F.transform("best", lambda b: b["score"]).alias("scores"))
    asked, groups = grouped(scope.table(ready, "ready"))

    def hard(members: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        mine_, own = asking.column("vec_id").to_numpy(), asking.column("label").to_numpy()
        that, theirs = (asking.column(c).to_pylist() for c in ("ids", "scores"))
        for ids, labels, at, scores in _blocks(members, asking, space):
            other = own[at][:, None] != labels
            for p in range(positives):
                whose = np.array([theirs[a][p] if p < len(theirs[a]) else -1 for a in at], np.int64)
                who = np.array([that[a][p] if p < len(that[a]) else -1 for a in at], np.int64)
                ok = other & (100 * scores <= high * whose[:, None]) & (100 * scores >= low * whose[:, None]) & (whose >= 0)[:, None]
                i, j = best_of(scores, ok, negatives)
                for held, found in zip(out, (mine_[at][i], who[i], ids[j], whose[i], scores[i, j]), strict=True):
                    held.append(found)
        return pa.table({c: pa.array(np.concatenate(held)) for c, held in zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), out, strict=True)})

    found = join(vectors, asked, groups, space, hard, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint", None, False, kept)
    scope.close()
    if found is None:
        return spark.createDataFrame([], MINED)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
