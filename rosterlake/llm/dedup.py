"""Exact duplicates, by DataFrame functions only.

Texts are equal when identical without the white space ``[\\x20\\x09-\\x0D]``;
groups are told by the SHA-256 of what is left.  A Misra-Gries summary (the
``approx_top_k`` sketch, which never misses a digest that holds more than one in
``TRACKED / 2`` rows) names the frequent digests, all that it tracks.  Their winners
are verified by an exact aggregation and broadcast, at most ``TRACKED`` rows, so rows
of frequent digests are settled where they lie; all other rows are shuffled by digest,
where no group holds more than one in ``TRACKED / 2`` rows.

Of a group the row with the most code points in its text stays, then the
smallest doc_id (null last), then one of the rows that share both.

Defined cases: null text is the empty text, and texts of white space only equal
it; rows may repeat; an empty table gives no rows; extra columns stay out of the
way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small

#: Digests that the summary counts and names as frequent.
TRACKED = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def marks(docs: DataFrame) -> DataFrame:
    """(row, doc_id, points, digest), materialised; ``row`` tells equal rows apart."""
    found = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"),
        digest(F.col("text")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    return cut(found)


def winners(found: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of each group."""
    order = F.struct("points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"), F.bitwise_not("row"))
    best = found.groupBy("digest").agg(F.max_by(F.struct("doc_id", "row"), order).alias("best"), F.count("*").alias("group_size"))
    return best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def frequent(found: DataFrame) -> DataFrame:
    """Winners of the frequent digests, at most TRACKED rows."""
    top = found.agg(F.expr(f"approx_top_k(digest, {TRACKED}, {TRACKED})").alias("top"))
    top = top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("digest"))
    return cut(winners(found.join(F.broadcast(top), "digest", "left_semi")))


def groups(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, digest."""
    found = marks(docs)
    split = found.join(F.broadcast(frequent(found)), "digest", "left")
    heavy = split.where("group_size is not null")
    rest = split.where("group_size is null").select(found.columns)
    rest = rest.join(winners(rest), "digest")
    kept = F.col("row") == F.col("keep_row")
    return heavy.unionByName(rest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged.

    Rows leave by tables of keys (digest, doc_id): those that lost to another doc_id, and
    of keys that repeat all rows but one.  Tables of checked size are broadcast; beyond it
    texts are shuffled, once for each table."""
    found = marks(docs)
    top = frequent(found)
    dg, none, key, kid, hit, one = (fresh(docs, c) for c in ("digest", "no_id", "id_key", "keep_id", "frequent_digest", "row"))
    own, spot = F.col("doc_id").cast("bigint"), [dg, none, key]
    rows = docs.withColumns({dg: digest(F.col("text")), none: own.isNull(), key: F.coalesce(own, F.lit(0))})
    # rows of frequent digests that do not win leave where they lie
    settled = top.select(F.col("digest").alias(hit), F.col("keep_id").alias(kid))
    rows = rows.join(F.broadcast(settled), F.col(dg) == F.col(hit), "left")
    rows = rows.where(F.col(hit).isNull() | own.eqNullSafe(F.col(kid))).drop(hit, kid)

    def keys(marked: DataFrame) -> DataFrame:
        return marked.select(F.col("digest").alias(dg), F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(key))

    rest = found.join(F.broadcast(top.select("digest")), "digest", "left_anti")
    lost = rest.join(winners(rest), "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    rows = rows.join(small(cut(keys(lost).distinct())), spot, "left_anti")
    again = cut(keys(found).groupBy(spot).count().where("count > 1").select(spot))
    if again.isEmpty():
        return rows.select(docs.columns)
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.char_length(F.coalesce("text", F.lit("")))).alias(one)
    repeated = rows.join(small(again), spot, "left_semi").groupBy(spot).agg(best).select(f"{one}.*")
    return rows.join(small(again), spot, "left_anti").select(docs.columns).unionByName(repeated)
