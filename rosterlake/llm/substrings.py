"""Passages that occur before, found by relative Lempel-Ziv parsing of documents.

A window is ``WINDOW`` consecutive words of a document.  A word goes if a window over it
has the same words as one that starts earlier: in a document of smaller id, or earlier in
the same document.  Which windows repeat is judged on the input.

1. Anchors.  A window's anchor is its run of ``GRAM`` words of least hash, so equal windows
   have equal anchors; a text has an anchor for some six words.  An anchor that occurs once
   in all texts belongs to windows that occur once: these need no more work.
2. Reference blocks.  Of an anchor that repeats, the first occurrence is the reference and
   all others cite it.  References are dealt into blocks by their document; a block gets
   the words around its references, and of each citing document the words around what
   cites it.  A block that is cited very often is copied, with a share of those that cite it.
3. Parsing.  A block indexes the windows of its references by hash.  Each citing slice is
   parsed from the left: the next window that the index has, at an earlier place, is
   extended word by word as far as the reference agrees; that is a factor, of ``WINDOW``
   words at least.  As a longer factor can hide a match that begins inside it, parsing goes
   on with the windows across the factor's edge.  Words are compared, not their hashes.
4. Windows that no factor covers although their anchor repeats (the contexts differ from
   the reference's) are told apart by a digest of 128 bits: all but the first of equal ones
   are repeated.  If a window has an earlier equal one that a block found, the block finds
   it for the window too; so what is left holds the first of all that are left, and the
   outcome is exact.
5. Spans of factors and windows go back to their documents.

Nothing is limited: an anchor that very many texts share is looked up by broadcast of at
most ``TRACKED`` references, or grouped by combining before the shuffle.

Defined cases: a null text has no words and keeps none; rows of one id and one text count
as one document, and each gets its result; rows of one id and different texts are put in
order by the text's digest; null ids go after all others; texts below a window's length
lose nothing; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from .common import HOT, HOT_ROWS, Scope, hot_keys, looked_up, small, small_batches
from .importance import text_bytes, word_bounds

WINDOW, GRAM = 20, 10
#: Frequent anchors that are looked up by broadcast.
TRACKED = 4096
#: References of a block, about, and citing anchors that one copy of a block takes.
REFERENCES, CITING = 20_000, 20_000
#: Bytes of a word that are hashed together with those of all others; longer words apart.
TOGETHER = 48
PARSED = "doc bigint, begin int, length int, digest binary"

#: 1 for the bytes of words: all but ASCII white space.
INSIDE = np.ones(256, np.uint8)
INSIDE[[0x20, *range(0x09, 0x0E)]] = 0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, all words advanced byte by byte together."""
    out = np.zeros(len(begin), np.uint64)
    if not len(begin):
        return out
    order = np.argsort(-length, kind="stable")
    at, size, state = begin[order], length[order], np.full(len(begin), 0xCBF29CE484222325, np.uint64)
    live = len(size) - np.searchsorted(size[::-1], np.arange(min(int(size[0]), TOGETHER)), side="right")
    for k, n in enumerate(live.tolist()):
        state[:n] = (state[:n] ^ data[at[:n] + k]) * np.uint64(0x100000001B3)
    for i in range(int(np.searchsorted(-size, -TOGETHER, side="left"))):
        state[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + size[i]].tobytes())
    out[order] = _mixed(state)
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by its first."""
    many = max(0, len(words) - n + 1)
    out = np.zeros(many, np.uint64)
    for k in range(n):
        out = out * _ODD + words[k : k + many]
    return _mixed(out)


def anchors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the anchor's first word in its row, hash) of all anchors of a batch
    of texts."""
    data, edges = text_bytes(column)
    begin, length, row = word_bounds(INSIDE[data], edges) if len(data) else (np.zeros(0, np.int64),) * 3
    many = len(begin) - WINDOW + 1
    if many <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashes = run_hashes(word_hashes(data, begin, length), GRAM)
    least, at = hashes[:many].copy(), np.arange(many)
    for k in range(1, WINDOW - GRAM + 1):
        there = hashes[k : k + many]
        better = there < least
        least = np.where(better, there, least)
        at = np.where(better, np.arange(k, k + many), at)
    at = at[row[:many] == row[WINDOW - 1 :]]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    first = np.searchsorted(row, row[at], side="left")
    return row[at], at - first, hashes[at]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, doc, at) of (doc, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, found = anchors(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32))], names=["anchor", "doc", "at"])

    return docs.select("doc", "text").mapInArrow(run, "anchor bigint, doc bigint, at int")


def cited(found: DataFrame) -> DataFrame:
    """(doc, at, ref) of the anchors that repeat; ``ref`` is the document of the first
    occurrence, null for that occurrence itself.  The summary names all anchors that one
    in TRACKED / 2 rows or more has; those are looked up, the rest is grouped."""
    # one row of TRACKED names at most
    top = found.agg(F.expr(f"approx_top_k(anchor, {TRACKED}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    hot = [t["item"] for t in top["top"] or [] if t["count"] > HOT_ROWS and t["count"] * HOT > top["n"]]
    spot = F.struct("doc", "at")
    told = lambda first: F.when(spot > F.col(first), F.col(f"{first}.doc")).alias("ref")
    is_hot = F.col("anchor").isin(hot)
    every = Over.partitionBy("anchor")
    cold = (found.where(~is_hot) if hot else found).select("doc", "at", F.min(spot).over(every).alias("first"), F.count("*").over(every).alias("n")).where("n > 1")
    out = cold.select("doc", "at", told("first"))
    if hot:
        firsts = found.where(is_hot).groupBy("anchor").agg(F.min(spot).alias("first"))
        out = out.unionByName(found.where(is_hot).join(F.broadcast(firsts), "anchor").select("doc", "at", told("first")))
    return out


def blocks(held: DataFrame) -> DataFrame:
    """(doc, marks): for each document the block, the number of the block's copies, whether
    it cites and the place of each of its repeated anchors."""
    references = held.where("ref IS NULL").count()
    many = max(1, -(-references // REFERENCES))
    spots = held.withColumn("block", F.pmod(F.xxhash64(F.coalesce("ref", "doc")), F.lit(many)))
    sizes = spots.where("ref IS NOT NULL").groupBy("block").agg(F.ceil(F.count("*") / CITING).cast("int").alias("copies")).where("copies > 1")
    spots = spots.join(small(sizes), "block", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return spots.groupBy("doc").agg(F.collect_list(F.struct("block", "copies", F.col("ref").isNotNull().alias("cites"), "at")).alias("marks"))


def slices(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(block, copy, cites, doc, begin, words): the words around the marks of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                copy = xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True))
                kinds: dict[tuple, list[int]] = {}
                for m in own:
                    kinds.setdefault((m["block"], m["copies"], m["cites"]), []).append(m["at"])
                for (block, copies, cites), at in kinds.items():
                    pieces = _around(sorted(set(at)), len(words))
                    for lo, hi in pieces:
                        piece = b" ".join(words[lo:hi])
                        out += [(block, k, cites, doc, lo, piece) for k in ([copy % copies] if cites else range(copies))]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "copy", "cites", "doc", "begin", "words"])

    return docs.join(marks, "doc").select("doc", "text", "marks").mapInArrow(run, "block bigint, copy int, cites boolean, doc bigint, begin int, words binary")


def _around(at: list[int], n: int) -> list[list[int]]:
    """Where windows with these anchors begin and end, joined where they meet."""
    out: list[list[int]] = []
    for a in at:
        lo, hi = max(0, a + GRAM - WINDOW), min(n, a + WINDOW)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return out


class Block:
    """The indexed windows of a block's references, earliest first among equal ones.

    ``ids``: the words of all slices, numbered, with a number of its own after each slice;
    ``doc``, ``at``: where a word stands."""

    def __init__(self, pieces: list[tuple[int, int, list[int]]]):
        pieces = sorted(pieces, key=lambda p: p[:2])
        self.ids = np.array(list(itertools.chain.from_iterable([*ids, -1] for _, _, ids in pieces)), np.int64)
        sizes = [len(ids) + 1 for _, _, ids in pieces]
        self.doc = np.repeat(np.array([d for d, _, _ in pieces], np.int64), sizes)
        begins = np.cumsum([0, *sizes[:-1]])
        self.at = np.arange(len(self.ids)) - np.repeat(begins - [b for _, b, _ in pieces], sizes) if pieces else np.zeros(0, np.int64)
        whole = np.concatenate([np.arange(b, b + s - WINDOW) for b, s in zip(begins, sizes, strict=True)]) if pieces else np.zeros(0, np.int64)
        found = window_hashes(self.ids)[whole] if len(whole) else np.zeros(0, np.uint64)
        order = np.lexsort([self.at[whole], self.doc[whole], found])
        self.hashes, self.places = found[order], whole[order]

    def parse(self, doc: int, begin: int, ids: np.ndarray) -> list[tuple[int, int]]:
        """(first word, length) of the factors of a slice that begins at a document's word
        ``begin``."""
        found = window_hashes(ids)
        first = np.searchsorted(self.hashes, found, side="left")
        there = np.minimum(first, max(0, len(self.hashes) - 1))
        hits = np.flatnonzero(self.hashes[there] == found) if len(self.hashes) else np.zeros(0, np.int64)
        place = self.places[there[hits]] if len(hits) else hits
        hits = hits[(self.doc[place] < doc) | ((self.doc[place] == doc) & (self.at[place] < begin + hits))]
        out, k = [], 0
        while k < len(hits):
            i = int(hits[k])
            length = self._factor(doc, begin + i, ids[i:], int(first[i]))
            if length:
                out.append((i, length))
                k = int(np.searchsorted(hits, i + length - WINDOW + 1))  # the first across its edge
            else:
                k += 1
        return out

    def _factor(self, doc: int, at: int, ids: np.ndarray, entry: int) -> int:
        """Words that agree with the earliest equal window of the index, 0 if none is earlier."""
        key = self.hashes[entry]
        while entry < len(self.hashes) and self.hashes[entry] == key:
            r = int(self.places[entry])
            if (int(self.doc[r]), int(self.at[r])) >= (doc, at):
                return 0
            n = min(len(ids), len(self.ids) - r)
            differ = np.flatnonzero(self.ids[r : r + n] != ids[:n])
            agree = int(differ[0]) if len(differ) else n
            if agree >= WINDOW:
                return agree
            entry += 1
        return 0


def window_hashes(ids: np.ndarray) -> np.ndarray:
    return run_hashes(_mixed(ids.astype(np.uint64) + _ODD), WINDOW)


def parsed(members: pa.Table) -> pa.Table:
    """Factors of the slices that cite a block, and digests of the windows outside them."""
    known: dict[bytes, int] = {}
    number = lambda words: [known.setdefault(w, len(known)) for w in words]
    rows = list(zip(members.column("cites").to_pylist(), members.column("doc").to_pylist(), members.column("begin").to_pylist(), members.column("words").to_pylist(), strict=True))
    block = Block([(doc, begin, number(words.split())) for cites, doc, begin, words in rows if not cites])
    out: list[tuple] = []
    for cites, doc, begin, words in rows:
        if not cites:
            continue
        each = words.split()
        factors = block.parse(doc, begin, np.array(number(each), np.int64))
        out += [(doc, begin + i, n, None) for i, n in factors]
        free = np.ones(max(0, len(each) - WINDOW + 1), bool)
        for i, n in factors:
            free[i : i + n - WINDOW + 1] = False
        out += [(doc, begin + i, WINDOW, xxhash.xxh3_128_digest(b" ".join(each[i : i + WINDOW]))) for i in np.flatnonzero(free).tolist()]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc", "begin", "length", "digest"])


def repeated_windows(free: DataFrame) -> DataFrame:
    """(doc, begin, length) of the windows (digest, doc, begin) that are not the first."""
    spot = F.struct("doc", "begin")
    counts = free.groupBy("digest").agg(F.min(spot).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = hot_keys(counts, "digest", free.count())
    return looked_up(free, counts.select("digest", "first"), "digest", hot).where(spot > F.col("first")).select("doc", "begin", F.lit(WINDOW).alias("length"))


def keyed(docs: DataFrame, scope: Scope) -> DataFrame:
    """(doc, doc_id, text): ``doc`` is one for rows of one id and text and puts documents
    in order.  It is the id itself where ids are neither null nor repeated."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    order = [F.asc_nulls_last("doc_id"), F.asc("h")]
    rows = rows.withColumn("h", F.sha2("text", 256))
    ids = rows.select("doc_id", "h").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    # a row's number is its range's, in the upper bits, and its place there
    ids = scope.table(ids.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").alias("id"), F.col("h").alias("g")), "ids")
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))).select("doc", "doc_id", "text")


def spans(docs: DataFrame, scope: Scope) -> DataFrame | None:
    """(doc, begin, length) of all repeated passages of (doc, text) rows; they may overlap."""
    held = scope.table(cited(scope.table(anchor_rows(docs), "anchors")), "cited")
    if held.isEmpty():
        return None
    found = slices(docs.select("doc", "text"), blocks(held)).groupBy("block", "copy").applyInArrow(parsed, PARSED)
    found = scope.table(found, "factors")
    free = found.where("digest IS NOT NULL").select("digest", "doc", "begin")
    return found.where("digest IS NULL").select("doc", "begin", "length").unionByName(repeated_windows(free))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): of each row of ``docs`` (doc_id, text) the
    words that stay, joined by one space."""
    spark = docs.sparkSession
    small_batches(spark)
    scope, kept = Scope(spark), Scope(spark, later=True)
    rows = keyed(docs, kept)
    found = spans(rows, scope)
    own = rows.withColumn("spans", F.lit(None).cast("array<struct<begin: int, length: int>>"))
    if found is not None:
        found = found.groupBy("doc").agg(F.collect_set(F.struct("begin", "length")).alias("spans"))
        own = rows.join(kept.table(found, "spans"), "doc", "left")
    scope.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words), bool)
                for s in cut or []:
                    gone[s["begin"] : s["begin"] + s["length"]] = True
                stay = list(itertools.compress(words, (~gone).tolist())) if cut else words
                out.append((len(words), len(words) - len(stay), b" ".join(stay).decode()))
            n, less, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(less, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return own.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
