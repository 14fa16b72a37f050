"""Importance resampling towards a target distribution, on hashed word runs.

Features of a text are all runs of one to three consecutive words, joined by a space and
repeats included; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  A
bucket's gain is the logarithm of its smoothed share in the target texts over that in the
raw ones, in thousandths; a document weighs the sum of its features' gains.  Weight plus
Gumbel noise, drawn from the document's id, orders the documents, and the highest are
drawn: that is sampling without replacement in proportion to the importance weights.

Features come from the bytes of an Arrow text column, no text is cut into Python strings.
A lookup table turns a byte into its lower-cased self or, between words, into zero; words
begin and end where that changes.  The CRC is a table-driven automaton, advanced over all
words of a batch at once: first over the first word of each run, then over a space and the
second word, then over a space and the third.

Two passes read the texts: one counts the buckets of the raw texts (a row per bucket and
task, summed by a shuffle), one weighs.  Only the ``BUCKETS`` gains go through the driver.
Ranks come from ranges of the scores, each sorted by one task, whose sizes are added up.

Defined cases: a null or empty text has no features and weighs nothing; a null id is drawn
as the empty id and goes after all others of its score; rows that repeat are scored and
drawn each; an empty table of raw or target texts counts as zero features; other columns
are left out.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, small_batches

BUCKETS = 10_000
#: Words of a feature at most.
RUN = 3
#: A document of fewer words is not drawn.
LEAST_WORDS = 20
#: Bytes that all words of a batch are advanced over together.  What a longer word has
#: beyond them is taken at once, as few words are that long.
TOGETHER = 64
DRAWN = "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"


def _classes() -> np.ndarray:
    """Of each byte: zero between words, else the byte, A-Z lower-cased.  Words are of
    digits, letters and all that is not ASCII."""
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    for first, last in ("09", "az"):
        out[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


def _crc_table() -> np.ndarray:
    """The step of the reflected CRC-32 for each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CLASSES, STEPS = _classes(), _crc_table()
#: The automaton's state before the first byte; a state's complement is the CRC.
START = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | np.uint8) -> np.ndarray:
    return STEPS[(state ^ byte).astype(np.uint8)] ^ (state >> np.uint32(8))


def advance(state: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The states after each one's ``length`` bytes of ``data`` from ``begin``."""
    if not len(state):
        return state
    order = np.argsort(-length, kind="stable")
    state, at, size = state[order], begin[order], length[order]
    # those that have a byte at offset k are the first live[k]
    live = len(size) - np.searchsorted(size[::-1], np.arange(min(int(size[0]), TOGETHER)), side="right")
    for k, n in enumerate(live.tolist()):
        state[:n] = _step(state[:n], data[at[:n] + k])
    for i in range(int(np.searchsorted(-size, -TOGETHER, side="left"))):  # those longer than TOGETHER
        rest = data[at[i] + TOGETHER : at[i] + size[i]].tobytes()
        state[i] = zlib.crc32(rest, int(~state[i])) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where its rows begin, and the last one ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edges = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def word_bounds(lowered: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, row) of each word; no word goes over the edge of a row."""
    inside = lowered != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = edges[:-1][edges[1:] > edges[:-1]]
    begins[filled] = inside[filled]
    ends[filled[1:] - 1] = inside[filled[1:] - 1]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1 - begin, np.searchsorted(edges, begin, side="right") - 1


def features(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all features of a text column, by their number of words."""
    data, edges = text_bytes(column)
    lowered = CLASSES[data]
    if not len(lowered):
        return
    begin, length, row = word_bounds(lowered, edges)
    state = np.full(len(begin), START)
    for n in range(RUN):
        if n:  # runs of n + 1 words: those of n, and the word after them in the same row
            many = len(begin) - n
            whole = np.flatnonzero(row[:many] == row[n:]) if many > 0 else np.zeros(0, np.int64)
            before = np.zeros(len(begin), np.uint32)
            before[at] = state
            at, state = whole, advance(_step(before[whole], np.uint8(32)), lowered, begin[whole + n], length[whole + n])
        else:
            at, state = np.arange(len(begin)), advance(state, lowered, begin, length)
        yield row[at], (~state % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts; buckets without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in features(batch.column(0), buckets):
                held += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[own])], names=["bucket", "n"])

    counts = texts.select(F.coalesce(F.col(column), F.lit("")).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in whole thousandths, from two tables of ``bucket_counts``."""
    spark = raw.sparkSession
    kinds = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    every = kinds.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t")))
    rows = every.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")).orderBy("bucket").collect()  # ``buckets`` rows
    s, t = np.array([r["s"] for r in rows]), np.array([r["t"] for r in rows])
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for batch in batches:
            n = batch.num_rows
            words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
            for k, (row, bucket) in enumerate(features(batch.column(1), len(value))):
                here = np.bincount(row, minlength=n)
                words, count = (here if k == 0 else words), count + here
                weight += np.bincount(row, value[bucket], minlength=n).astype(np.int64)  # whole and below 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int = 42) -> Column:
    """Gumbel noise in whole thousandths, from a hash of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def ranked(rows: DataFrame, many: int, scope: Scope) -> DataFrame:
    """``rows`` (doc_id, score, ..) with ``rank``, from 1, of the ``many`` highest scores,
    ties by smaller doc_id; null beyond.  Each task sorts a range of scores; the sizes of
    the ranges, one number a task, tell where its ranks begin."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # a row's number is its task's, in the upper bits, and its place there
    held = scope.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a task
    ahead = list(itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=0))
    rank = F.get(F.lit(ahead).cast("array<bigint>"), part.cast("int")) + place + 1
    return held.withColumn("rank", F.when(rank <= many, rank)).drop("at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).
    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) of
    highest score have a rank, from 1; the ``target`` texts tell what to draw towards."""
    spark = docs.sparkSession
    small_batches(spark)
    scope, kept = Scope(spark), Scope(spark, later=True)
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets), buckets)
    scored = kept.table(weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fits = F.col("n_words") >= least_words
    many = scored.where(fits).count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(scored.where(fits).select(out), many, kept)
    return drawn.select(*out, "rank").unionByName(scored.where(~fits).select(*out, F.lit(None).cast("bigint").alias("rank")))
