"""People who may be among the best for a query, found without scoring their works.

``profiles`` is a table made once: a row a person, with, for each of their works, the title
key, hashes of title and abstract terms, and the vector in a byte a component (a sketch),
with how far the vector is from its sketch.  A prolific person has several rows, none with
two works of one title key.

Of a work and a query a sketch gives the cosine up to that distance (by the Cauchy-Schwarz
inequality), terms give the keyword part, and whether all terms are there tells whether a
phrase can be.  So a work's score lies between two bounds, and a person's: of works with one
title key the best of the published ones counts, or the best of all if none is published,
and the five best count, each with a weight above zero, so bounds of works make bounds of
people.  A person may be among the best ``limit`` only if their upper bound reaches the
``limit``-th lower bound.  A task drops those that fail by its own people at once; what it
gives is a few people a query, not a row for each query and work.

The bounds do not decide a rank: works of the people found are scored exactly.  Terms and
title keys are told apart by 64-bit hashes here.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import scoring

#: Works of a row of ``profiles``, about; query rows that are broadcast at once; scores that
#: are computed at once.
ROW_WORKS, QUERY_BATCH, AT_ONCE = 2000, 1000, 1 << 20
#: More than scores differ by rounding, to four places and in the last bits.
SLACK = 2e-4
CODED = "work_id bigint, code binary, step double, off double"
FOUND = "query_id bigint, professor_id bigint, lows array<double>, highs array<double>"


def sketches(rows: DataFrame) -> DataFrame:
    """(work_id, code, step, off): each unit vector in whole steps of a byte a component,
    and the norm of what that leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, steps, offs = [], [], []
            for v in batch.column(1).to_pylist():
                x = np.asarray(v, np.float64)
                size = np.sqrt(x @ x)
                x = x / size if size > 0 else x
                step = float(np.abs(x).max(initial=0.0)) / 127
                code = np.round(x / step).astype(np.int8) if step else np.zeros(len(x), np.int8)
                rest = x - step * code
                codes.append(code.tobytes())
                steps.append(step)
                offs.append(float(np.sqrt(rest @ rest)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(steps, pa.float64()), pa.array(offs, pa.float64())], names=["work_id", "code", "step", "off"])

    return rows.select(F.col("work_id").cast("bigint").alias("work_id"), "embedding").mapInArrow(run, CODED)


def profiles(prepared: DataFrame, links: DataFrame) -> DataFrame:
    """(professor_id, parts, works) of all linked people, from ``search.prepare_works``."""
    terms = lambda c: F.transform(F.filter(F.array_distinct(c), lambda t: F.char_length(t) > 2), lambda t: F.xxhash64(t))
    about = prepared.select(F.col("work_id").cast("bigint").alias("work_id"), F.xxhash64("title_key").alias("title"), "preprint", terms("title_tokens").alias("in_title"), terms("abstract_tokens").alias("in_abstract"))
    one = about.join(sketches(prepared), "work_id")
    theirs = links.select("professor_id", "work_id").distinct()
    sizes = theirs.groupBy("professor_id").agg(F.ceil(F.count("*") / ROW_WORKS).cast("int").alias("parts"))
    rows = theirs.join(one, "work_id").join(sizes, "professor_id")
    work = F.struct("title", "preprint", "in_title", "in_abstract", "code", "step", "off")
    return rows.groupBy("professor_id", "parts", F.pmod("title", "parts").alias("part")).agg(F.collect_list(work).alias("works")).select(F.col("professor_id").cast("bigint").alias("professor_id"), "parts", "works")


@dataclass(frozen=True)
class Asked:
    """Queries as a task needs them: which terms each has, by the terms' sorted hashes, how
    many, whether there can be a phrase, and unit vectors by their length."""

    ids: np.ndarray
    hashes: np.ndarray
    terms: np.ndarray  # queries x hashes, 0 or 1
    phrased: np.ndarray
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]  # length: queries, rows

    @classmethod
    def of(cls, rows: list[Row]) -> Asked:
        own = [[h for t, h in zip(r["query_tokens"], r["hashes"], strict=True) if len(t) > 2] for r in rows]
        hashes = np.unique(np.array(list(itertools.chain(*own)), np.int64))
        terms = np.zeros((len(rows), len(hashes)), np.float32)
        for i, found in enumerate(own):
            terms[i, np.searchsorted(hashes, found)] = 1
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r["query_vector"]), []).append(i)
        unit = {}
        for n, members in by.items():
            x = np.array([rows[i]["query_vector"] for i in members], np.float64).reshape(len(members), n)
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            unit[n] = (np.array(members), np.divide(x, size, out=np.zeros_like(x), where=size > 0))
        return cls(np.array([r["query_id"] for r in rows], np.int64), hashes, terms, np.array([len(f) > 1 for f in own]), unit)


def _common(lists: pa.ListArray, asked: Asked) -> np.ndarray:
    """Queries x works: how many of a query's terms a work has."""
    flat, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    has = np.zeros((len(lists), len(asked.hashes)), np.float32)
    if len(asked.hashes) and len(flat):
        at = np.minimum(np.searchsorted(asked.hashes, flat), len(asked.hashes) - 1)
        hit = asked.hashes[at] == flat
        has[row[hit], at[hit]] = 1
    return (asked.terms @ has.T).astype(np.float64)


def work_bounds(title_terms: pa.ListArray, abstract_terms: pa.ListArray, code: pa.Array, step: np.ndarray, off: np.ndarray, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Queries x works: least and greatest score."""
    size = asked.terms.sum(axis=1)[:, None].astype(np.float64)
    low, room = np.zeros((len(asked.ids), len(step))), np.zeros((len(asked.ids), len(step)))
    codes = code.to_pylist()
    lengths = np.array([len(c) for c in codes], np.int64)
    for n, (queries, unit) in asked.vectors.items():
        own = np.flatnonzero(lengths == n)
        if n and len(own):
            x = np.frombuffer(b"".join(codes[i] for i in own), np.int8).reshape(len(own), n).astype(np.float64)
            spot = np.ix_(queries, own)
            some = (unit != 0).any(axis=1)[:, None]
            low[spot] = 0.65 * ((unit @ x.T) * step[own] - some * off[own])
            room[spot] = 1.3 * some * off[own]
    phrase = np.zeros_like(low)
    for weight, part, lists in ((0.2, 0.05, title_terms), (0.1, 0.025, abstract_terms)):
        common = _common(lists, asked)
        low += weight * common / np.maximum(size, 1)
        phrase = np.maximum(phrase, part * ((common == size) & asked.phrased[:, None]))
    return low, low + room + phrase


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, or all, greatest first."""
    if values.shape[1] > k:
        values = -np.partition(-values, k - 1, axis=1)[:, :k]
    return -np.sort(-values, axis=1)


def may_lead(profile: DataFrame, asked: Asked, limit: int, work_limit: int) -> DataFrame:
    """(query_id, professor_id, lows, highs): bounds of the best works of the people who may
    be among the best of their task, and of all who have several rows."""
    shared = profile.sparkSession.sparkContext.broadcast(asked)
    weights = np.array(scoring.TOP_WORK_WEIGHTS[:work_limit])
    top = len(scoring.TOP_WORK_WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        lead = np.full((len(q.ids), limit), -np.inf)  # the best lower bounds so far
        for batch in batches:
            people, parts, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            ends = np.cumsum(np.diff(column.offsets.to_numpy()))
            lo = 0
            while lo < len(people):
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + max(1, AT_ONCE // len(q.ids)), side="right")))
                lows, highs = _people(column.slice(lo, hi - lo), q, top)
                low = np.stack([x[:, : len(weights)] @ weights[: x.shape[1]] for x in lows], axis=1)
                high = np.stack([x[:, : len(weights)] @ weights[: x.shape[1]] for x in highs], axis=1)
                whole = parts[lo:hi] == 1
                lead = _best(np.hstack([lead, low[:, whole]]), limit)
                i, j = np.nonzero((high >= lead[:, -1:] - SLACK) | ~whole)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(people[lo:hi][j]), pa.array([lows[b][a].tolist() for a, b in zip(i, j, strict=True)], pa.list_(pa.float64())), pa.array([highs[b][a].tolist() for a, b in zip(i, j, strict=True)], pa.list_(pa.float64()))], names=["query_id", "professor_id", "lows", "highs"])
                lo = hi

    return profile.select("professor_id", "parts", "works").mapInArrow(run, FOUND)


def _people(column: pa.ListArray, q: Asked, top: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each person queries x their best works: least and greatest scores."""
    person = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    title, preprint, in_title, in_abstract, code, step, off = column.flatten().flatten()
    key, late = title.to_numpy(), preprint.to_numpy(zero_copy_only=False).astype(bool)
    bounds = work_bounds(in_title, in_abstract, code, step.to_numpy(), off.to_numpy(), q)
    order = np.lexsort([key, person])
    begins = np.flatnonzero(np.append(True, (person[order][1:] != person[order][:-1]) | (key[order][1:] != key[order][:-1])))
    group = np.cumsum(np.bincount(begins, minlength=len(order))) - 1
    published = np.maximum.reduceat((~late[order]).astype(np.int8), begins)[group] == 1
    passed_over = late[order] & published
    owner = person[order][begins]
    edges = np.searchsorted(owner, np.arange(len(column) + 1))
    out = []
    for b in bounds:
        held = np.where(passed_over, -np.inf, b[:, order])
        best = np.maximum.reduceat(held, begins, axis=1)
        out.append([_best(best[:, a:z], top) for a, z in itertools.pairwise(edges.tolist())])
    return out[0], out[1]


def candidates(profile: DataFrame, who: DataFrame, ready: DataFrame, limit: int, work_limit: int = 5) -> DataFrame:
    """(query_id, professor_id) of people in ``who`` who may be among the best ``limit`` for
    a query; ``ready``: query_id, query_tokens, query_vector."""
    rows = ready.withColumn("hashes", F.transform("query_tokens", lambda t: F.xxhash64(t))).orderBy("query_id").toLocalIterator()
    theirs, found = profile.join(who.select("professor_id"), "professor_id", "left_semi"), None
    while part := list(itertools.islice(rows, QUERY_BATCH)):
        own = may_lead(theirs, Asked.of(part), limit, work_limit)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return profile.sparkSession.createDataFrame([], "query_id bigint, professor_id bigint")
    whole = found.groupBy("query_id", "professor_id").agg(*[scoring.discounted_sum(F.flatten(F.collect_list(c)), work_limit).alias(c) for c in ("lows", "highs")])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lows"), "professor_id"))
    least = whole.withColumn("place", place).where(F.col("place") == limit).select("query_id", F.col("lows").alias("least"))
    kept = whole.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("highs") >= F.col("least") - SLACK))
    return kept.select("query_id", "professor_id")
