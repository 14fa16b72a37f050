"""The vectors most like a query, exactly, by pivots and the triangle inequality.

``index`` is a table made once: each unit vector in the cell of the pivot nearest to it,
with its angle to that pivot, sorted by angle within a cell.  Angles keep the triangle
inequality, so a vector at angle b from the pivot of its cell is at least |a - b| from a
query at angle a from that pivot.

A query looks into the cells nearest to it until they hold k vectors.  The k-th best angle
there bounds how far the answer can lie, and leaves of each cell only vectors whose angle to
the pivot is within it of the query's: a filter on cell and angle, which the scan uses to
skip folders and row groups.  What is left is compared exactly, so the result is that of
comparing all.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Vectors that pivots are fitted on, and rounds of that; cells at most.
SAMPLE, ROUNDS, CELLS = 4096, 6, 256
#: More than an angle differs by rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Rows (id, embedding, cell, angle) of vectors that have a direction, and, with a cosine
    of 0 to every query, those that have none; the pivots and the size of each cell."""

    rows: DataFrame
    rest: DataFrame
    pivots: np.ndarray
    sizes: dict[int, int]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def pivots_of(rows: DataFrame, key: str, n: int) -> np.ndarray:
    """Means of a spherical k-means over the ``SAMPLE`` vectors of smallest hash of the key."""
    found = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("embedding").collect()
    x = _unit(np.array([r[0] for r in found], np.float64))
    many = min(len(x), CELLS, max(1, round(math.sqrt(n) / 2)))
    out = x[np.random.default_rng(5).permutation(len(x))[:many]]
    for _ in range(ROUNDS):
        near = (x @ out.T).argmax(axis=1)
        out = _unit(np.array([x[near == c].sum(axis=0) if (near == c).any() else out[c] for c in range(many)]))
    return out


def index(rows: DataFrame, key: str, path: str) -> Index:
    """An index of ``rows`` (key, embedding), written below ``path``.  Vectors of the most
    common length have a place in it; others, null and zero ones have a cosine of 0."""
    spark, size = rows.sparkSession, vectors.norm(F.col("embedding"))
    rows = rows.select(key, "embedding")
    lengths = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    has = F.coalesce((F.size("embedding") == dim) & (size > 0), F.lit(False))
    fine = rows.where(has)
    n = fine.count()
    pivots = pivots_of(fine, key, n) if n else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                cosine = x @ shared.value.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[key, "embedding", "cell", "angle"])

    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding {rows.schema['embedding'].dataType.simpleString()}, cell int, angle double"
    filed = fine.mapInArrow(run, schema)
    filed.repartition("cell").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{path}/filed")
    rows.where(~has).write.parquet(f"{path}/rest")
    held = spark.read.schema(filed.schema).parquet(f"{path}/filed") if n else filed
    sizes = {r["cell"]: r["count"] for r in held.groupBy("cell").count().collect()}  # CELLS at most
    return Index(held, spark.read.schema(rows.schema).parquet(f"{path}/rest"), pivots, sizes)


def within(found: Index, query: np.ndarray, reach: float) -> Column:
    """Which rows can be at an angle of at most ``reach``."""
    to = np.arccos(np.clip(found.pivots @ query, -1, 1))
    some = [(F.col("cell") == c) & F.col("angle").between(float(to[c]) - reach - SLACK, float(to[c]) + reach + SLACK) for c in found.sizes]
    return functools.reduce(operator.or_, some, F.lit(False))


def nearest(found: Index, key: str, query: list[float], k: int, places: int = 6) -> tuple[DataFrame, Column]:
    """(key, cosine) of the k rows of greatest cosine, rounded to ``places``, ties to the
    smaller key; and the condition on cell and angle that the rows compared fulfil."""
    q = _unit(np.asarray(query, np.float64))
    score = F.round(vectors.cosine_to(query)(F.col("embedding")), places).alias("cosine")
    order = [F.desc("cosine"), F.asc(key)]
    none = found.rest.select(key, F.lit(0.0).alias("cosine"))
    if not found.sizes or len(q) != found.pivots.shape[1] or not q.any():
        return found.rows.select(key, score).unionByName(none).orderBy(*order).limit(k), F.lit(True)
    near, held = [], 0
    for c in np.argsort(-(found.pivots @ q), kind="stable").tolist():
        if held >= k:
            break
        near.append(c)
        held += found.sizes.get(c, 0)
    first = found.rows.where(F.col("cell").isin(near)).select(score).orderBy(F.desc("cosine")).limit(k).agg(F.min("cosine"), F.count("*")).first()
    # ties at the rounded k-th cosine count, and rows without a direction if it is not above zero
    reach = math.pi if first[1] < k else math.acos(max(-1.0, min(1.0, first[0] - 10.0**-places)))
    some = within(found, q, reach)
    return found.rows.where(some).select(key, score).unionByName(none).orderBy(*order).limit(k), some
