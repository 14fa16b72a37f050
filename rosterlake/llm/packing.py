"""Best-fit packing of token pieces into sequences.

Documents are cut into pieces of at most ``max_tokens`` ids.  A sequence has
three capacities: tokens, pieces and attention cost (the sum over its pieces of
length squared).  *Vector best fit*: pieces go longest first to the open
sequence that the score over the residual capacities prefers among those that
all three constraints admit.

By default a sequence may hold as many pieces as tokens and the attention cost of one
full piece, so the tokens bind first: a piece has a token at least, and a sum of squares
is at most the square of the sum.  Fewer pieces or less attention, where a trainer
bounds them, bind before the tokens and cost sequences.

What a sequence can still take depends only on the lengths in it, so the plan is
made for counts, not rows: the corpus is reduced to a histogram of piece lengths
(at most ``max_tokens`` rows, whatever the corpus) and sequences with equal
contents are kept as one run of consecutive ids.  The plan is a list of
placements "pieces ``rank..rank+n`` of length l go to sequences ``bin..bin+n`` at
offset o"; rows find theirs by their rank within their length.  Ranks come from
windows over (length, salt), so a length shared by most rows is dealt over many
tasks.

Defined cases: null text is the empty text; documents repeated in the input are
packed as often as they occur, rows equal in id and piece in the order of a hash of
their other columns; an empty table gives no rows; extra columns are carried along.
Null lengths count as zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, fresh, small_batches

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
#: Rows of one (length, salt) group stay near this number.
ROWS_PER_SALT = 20_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, pieces, sum of squared piece lengths."""

    tokens: int = 2048
    pieces: int | None = None  # None: as many as tokens
    attention: int | None = None  # None: tokens squared, all that one full piece needs

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces or self.tokens, self.attention or self.tokens**2], dtype=np.float64)


def encode_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, max_tokens: int = 2048) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of each document's ids and end id.
    ``ids`` holds little-endian unsigned 32-bit ids."""
    path = tokenizer or tokens.default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for key, raw in zip(keys, encoder.encode([t or "" for t in texts]), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * max_tokens)):
                    part = raw[at : at + 4 * max_tokens]
                    out.append((key, piece, at // 4, len(part) // 4, part))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Placements sorted by (length, rank); sequences 0..n_sequences-1."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 40) + self.rank, (length << 40) + rank, side="right") - 1
        return self.bin[at] + rank - self.rank[at], self.offset[at]


def best_fit_plan(histogram: dict[int, int], capacity: Capacity, score: str = "dot", weights: tuple[float, float, float] = (1.0, 0.05, 0.25)) -> Plan:
    """Vector best fit, longest first, over counts of equal lengths.

    ``score``: "dot" prefers the greatest weighted dot product of a piece's
    demand with what the sequence has used, both as shares of capacity (the
    fullest sequence that fits); "norm" the smallest weighted norm of what
    would be left.  Ties go to the sequence opened first.
    """
    full, w = capacity.vector(), np.asarray(weights)
    first: list[int] = []  # runs of equal sequences: first id, how many, residuals
    count: list[int] = []
    residual = np.zeros((0, 3))
    places: list[tuple[int, int, int, int]] = []
    n_bins = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        demand = np.array([length, 1, length * length], dtype=np.float64)
        if (demand > full).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        while left:
            fits = np.flatnonzero((residual >= demand).all(axis=1))
            if len(fits):
                share = residual[fits] / full
                value = ((1 - share) * w) @ (demand / full) if score == "dot" else -np.sqrt((w * (share - demand / full) ** 2).sum(axis=1))
                run = int(fits[np.argmax(value)])
                n, at, room = min(left, count[run]), first[run], residual[run].copy()
                if n == count[run]:
                    residual[run] = room - demand
                else:  # the rest of the run keeps its content
                    first.append(at), count.append(n)
                    residual = np.vstack([residual, room - demand])
                    first[run], count[run] = at + n, count[run] - n
            else:
                n = left  # a new sequence each: no open one takes this length
                per = max(1, min(int(full[0] // max(length, 1)), int(full[1]), int(full[2] // max(length * length, 1))))
                n, at, room = -(-left // per), n_bins, full
                n_bins += n
                first.append(at), count.append(n)
                residual = np.vstack([residual, full - demand])
            places.append((length, rank, at, int(full[0] - room[0])))
            left, rank = left - n, rank + n
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], n_bins)


def pack(pieces: DataFrame, capacity: Capacity | None = None, score: str = "dot") -> DataFrame:
    """``pieces`` (any rows with a ``length``) with ``sequence_id`` and ``offset``.

    The rows are materialised once.  To the driver go the counts of at most
    ``capacity.tokens + 1`` lengths; the plan broadcast has a few runs a length.
    """
    capacity = capacity or Capacity()
    pieces = pieces.drop("sequence_id", "offset")
    salt, ahead, rank = (fresh(pieces, c) for c in ("salt", "ahead", "rank"))
    named = [c for c in ("doc_id", "piece") if c in pieces.columns]
    others = [F.col(f"`{f.name}`") for f in pieces.schema if f.name not in (*named, "length") and "map<" not in f.dataType.simpleString()]
    # rows that tie on all of these are equal: a window that runs again places them alike
    order = [*named, F.xxhash64(*others)] if others else named or ["length"]
    rows = cut(pieces.withColumn("length", F.coalesce(F.col("length"), F.lit(0)).cast("bigint")))
    counts = rows.groupBy("length").count().collect()
    if not counts:
        return rows.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    histogram = {int(r["length"]): int(r["count"]) for r in counts}
    plan = best_fit_plan(histogram, capacity, score)
    n_salts = max(8, -(-max(histogram.values()) // ROWS_PER_SALT))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(n_salts)).cast("int"))
    within = rows.groupBy("length", salt).agg(F.count("*").alias(ahead))
    before = within.withColumn(ahead, F.sum(ahead).over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)))
    ranked = ranked.join(before, ["length", salt]).withColumn(rank, F.col(rank) - 1 + F.coalesce(F.col(ahead), F.lit(0)))
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        bins, offsets = shared.value.find(length.to_numpy(np.int64), at.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    spot = fresh(ranked, "spot")
    placed = ranked.withColumn(spot, place(F.col("length"), F.col(rank).cast("bigint")))
    return placed.select(*pieces.columns, f"{spot}.sequence_id", f"{spot}.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: Capacity | None = None) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset."""
    capacity = capacity or Capacity()
    return pack(encode_pieces(docs, tokenizer, end_id, capacity.tokens), capacity)
