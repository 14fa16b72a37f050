"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, HOT_ROWS, Scope, hot_keys, looked_up, remove, table


def _sums(edges: DataFrame) -> tuple[int, object, int]:
    """Number and checksum of the edges, and the most that have one smaller end."""
    by = edges.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
    return tuple(by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", scope: Scope | None = None) -> DataFrame:
    """(node, component) of every node with an edge to another one; a component
    is named by its smallest node.

    Alternates two steps until the edges stay the same.  Edges go from the larger end u to
    the smaller one v.  First an edge moves its smaller end to the smallest neighbour that
    this one has; then a node points its smaller neighbours, and itself, at the smallest of
    them.  Both keep components whole and the number of rounds grows with the logarithm
    of the longest path.  Half of all edges may end in one node, the middle of a star: such
    ends are looked up by broadcast.  Each round is written to the shared folder and read
    again; only the last one's table stays there, for ``scope`` to remove.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, held = table(e, "edges")
    seen = _sums(e)
    while seen[0]:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hot = hot_keys(e.groupBy("v").agg(F.count("*").alias("n")), "v", seen[0]) if seen[2] > max(HOT_ROWS, seen[0] // HOT) else []
        large = looked_up(e, least.withColumnRenamed("u", "v"), "v", hot).select("u", F.coalesce("m", "v").alias("v")).distinct()
        pairs = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e, path = table(pairs.select(ends.alias("e")).select("e.u", "e.v").where("u > v").distinct(), "edges")
        remove(e.sparkSession, held)
        held, now = path, _sums(e)
        if now == seen:
            break
        seen = now
    if scope is not None:
        scope.paths.append(held)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
