"""SimHash near-duplicates by the general pigeonhole principle.

A document's words make shingles; each shingle's hash votes on every bit of a
fingerprint.  Equal fingerprints become one node.  Two nodes link if their
fingerprints are near; documents of one connected component are near-duplicates.

Search.  Bits that vary together are grouped into the same partition.  Every
partition i gets a threshold t_i: a node is filed under its key in the partition
and, for t_i > 0, under all keys within t_i bits (t_i = -1 leaves the partition
out).  A dynamic program over the partitions allots the thresholds that cost
least, by candidate counts taken from the key counts of all nodes:

* exact search within r bits: the sum of (t_i + 1) must reach r + 1, which by
  the general pigeonhole principle leaves no pair out;
* similarity search: fingerprints of 1024 bits estimate the share of common
  shingles.  The chance that a pair at the similarity asked for meets in no
  partition must stay under ``miss``.

A node is filed under all keys of its ball, so nodes up to 2 t_i bits apart in a
partition meet.  Partitions are wider, and keys fewer to a bucket, the more nodes there
are: their number is chosen by the rows that a plan files and the nodes that meet.

Nodes that meet in a bucket are verified in full.  In a similarity search the
fingerprints decide only pairs that they leave no doubt of.  Once these have made
classes, nodes that may link to one of another class in their bucket meet there again
with their shingle sets, and exact Jaccard similarities settle it (``_settled``); only
links come out, so a crowd of texts near the threshold costs comparisons and no rows.
Pairs with a text of over ``LONG`` shingles are settled one by one.  Texts of few shingles, whose bits differ more often than the rule for many says, are searched a
second time by thresholds of their own (``lanes``).

All buckets follow one rule: nodes that share a bucket and whose sketches, the first
bits of their fingerprints, are near enough are verified.  A bucket of over ``BUCKET``
nodes takes more tasks to do so (``_blocks``), in an exact search by the points that
lie within one bit of two nodes (``_points``); the links that connect are the same at
any bucket size.  A bucket yields a spanning forest of its links, never all pairs.

Defined cases: null text is the empty text; texts without words share
fingerprint zero and link like any other; fewer words than a shingle has make
one shingle; rows are told apart by doc_id and text, so rows that share a doc_id are
judged each by its own text; null doc_ids come after all others, and a component
without any other has a null component_id; an empty table gives no rows; extra
columns stay out of the way.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, fresh, hot_keys, looked_up, small, small_batches
from .graph import components

#: Nodes of a bucket that are verified in one list, and on each side of a block of a larger
#: bucket; pairs that a task has in hand at once.
BUCKET, BLOCK, PAIRS = 1024, 1024, 100_000
#: Words of a fingerprint that travel with a key.
SKETCH_WORDS = 2
#: Sketches of a pair that links differ by at most so many deviations more than those of
#: a pair at the similarity asked for do on average: fewer than one such pair in a million
#: is lost.
SKETCH_SIGMAS = 5
#: Cost of comparing two sketches, in rows filed.
COMPARING = 1 / 32
#: Texts with fewer shingles than these have bounds of their own, see ``rules``.
FEW = (9, 64)
#: A pair is sure, or out of the question, this many deviations of the differing bits
#: from where it could be otherwise: a chance of one in 30,000 a pair at the bound.
SURE_SIGMAS = 4
#: Shingles of a text that may travel to a bucket.
LONG = 4096
#: Nodes of a large bucket that all its others are compared with first.
LEADERS = 32
_LANES = np.uint64(0x0001000100010001)


# -- fingerprints


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z in lower case, words apart at
    ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    k = min(words, len(found))
    line = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: len(ends) - k]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :], strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of ``sizes`` hashes: the bits set in over half of a run.  Sixteen
    16-bit counters are summed in one word; longer runs are summed in parts."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    parts = -(-n // 65_535)
    first_part = np.concatenate([[0], np.cumsum(parts)[:-1]])
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    starts = np.repeat(begin, parts) + 65_535 * (np.arange(parts.sum()) - np.repeat(first_part, parts))
    found = np.zeros(len(full), np.uint64)
    for i in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(i)) & _LANES, starts)
        for j in range(4):
            count = np.add.reduceat((lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF), first_part).astype(np.int64)
            found |= (2 * count > n).astype(np.uint64) << np.uint64(i + 16 * j)
    out[full] = found
    return out


def widen(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made from a 64-bit one (k = 0: itself)."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): what tells rows apart, and the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """(doc_id, text_key, fp, shingles): ``fp`` is binary, little-endian words of 64
    bits; ``distinct`` lets each different shingle vote once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t or "", words) for t in batch.column(2).to_pylist()]
            if distinct:
                hashes = [np.unique(h) for h in hashes]
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            marks = np.stack([majority(widen(flat, k), sizes) for k in range(bits // 64)], axis=1).astype("<u8")
            raw, wide = marks.tobytes(), bits // 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], pa.binary()), pa.array(sizes, pa.int64())],
                names=["doc_id", "text_key", "fp", "shingles"],
            )

    return keyed(docs).mapInArrow(run, "doc_id bigint, text_key bigint, fp binary, shingles bigint")


# -- the plan


@dataclass(frozen=True)
class Search:
    """Within ``radius`` bits exactly, or (radius None) at a Jaccard similarity of
    ``similarity``, missing a pair there with a chance under ``miss``.  ``share`` is the
    share of differing bits to plan for, where it is not that of many shingles."""

    bits: int = 64
    radius: int | None = 2
    similarity: float = 0.8
    miss: float = 0.02
    share: float | None = None

    def differ(self) -> float:
        """The share of bits that differ, on average, at ``similarity`` between
        documents of one size."""
        if self.share is not None:
            return self.share
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    def sketch(self) -> tuple[int, int]:
        """Words of a sketch, and the most bits in which those of a pair may differ."""
        words = min(SKETCH_WORDS, self.bits // 64)
        if self.radius is not None:
            return words, self.radius
        d = self.differ()
        return words, math.ceil(64 * words * d + SKETCH_SIGMAS * math.sqrt(64 * words * d * (1 - d)))


def differing(na: int, nb: int, common: int) -> float:
    """The chance that a bit differs between majorities of ``na`` and of ``nb`` hashes
    that have ``common`` ones in common; a tie is no majority."""
    k = np.arange(common + 1)
    both = np.array([math.comb(common, i) / 2**common for i in k])

    def on(n: int) -> np.ndarray:
        own, need = n - common, n // 2 + 1 - k
        tail = np.cumsum([math.comb(own, i) / 2**own for i in range(own, -1, -1)])[::-1]
        return np.where(need <= 0, 1.0, np.where(need > own, 0.0, tail[np.clip(need, 0, own)]))

    a, b = on(na), on(nb)
    return float((both * (a * (1 - b) + b * (1 - a))).sum())


def least_common(n, similarity: float):
    """The common shingles that sets of ``n`` together need."""
    return np.ceil(similarity * n / (1 + similarity) - 1e-9)


@dataclass(frozen=True)
class Rules:
    """Pairs of at most ``sure`` differing bits link.  ``shares`` are the largest shares
    of bits that differ at the similarity asked for, of texts with under ``FEW[0]``,
    under ``FEW[1]`` and more shingles; ``most`` the bits beyond which a pair is out."""

    sure: int
    shares: tuple[float, ...]
    most: tuple[int, ...]


@functools.cache
def rules(bits: int, similarity: float) -> Rules:
    """From the exact chances for few shingles.  The bias of majorities falls with the
    count, so those at ``FEW[1]`` bound all larger ones."""
    top, low = [0.0] * (len(FEW) + 1), math.acos(math.sqrt(similarity)) / math.pi
    for na in range(1, FEW[-1] + 9):
        at = sum(na >= f for f in FEW)
        for nb in range(na, math.floor(na / similarity + 1e-9) + 2):
            common = int(least_common(na + nb, similarity))
            if common <= na:
                top[at] = max(top[at], differing(na, nb, common))
            if 0 < common <= na + 1:
                low = min(low, differing(na, nb, common - 1))
    wide = lambda d: SURE_SIGMAS * math.sqrt(bits * d * (1 - d))
    return Rules(math.floor(bits * low - wide(low)), tuple(top), tuple(math.ceil(bits * d + wide(d)) for d in top))


def lanes(search: Search) -> list[tuple[int | None, Search]]:
    """The searches that find all pairs: (the most shingles of a node or None, search)."""
    shares = rules(search.bits, search.similarity).shares
    few = [(math.floor((f - 1) / search.similarity + 1e-9), replace(search, share=d)) for f, d in zip(FEW, shares, strict=False)]
    return [(None, search), *few[::-1]]


def ball(bits: int, t: int) -> int:
    return sum(math.comb(bits, i) for i in range(t + 1))


def co_occurrence(nodes: DataFrame, bits: int) -> np.ndarray:
    """Over all nodes, for each 64-bit word: how often two bits are set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits // 64, 64, 64))
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, bits // 64, 8)
            for k in range(bits // 64):
                on = np.unpackbits(raw[:, k, :], axis=1, bitorder="little").astype(np.float32)
                total[k] += on.T @ on
        where = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(total.ravel()[where].astype(np.int64), pa.int64())], names=["at", "n"])

    out = np.zeros(bits * 64)
    for r in nodes.select("fp").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out.reshape(bits // 64, 64, 64)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits of one word in ``parts`` groups, each grown from the most correlated
    pair left by the bit most correlated with the group."""
    share = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for p in range(parts):
        size = (64 * (p + 1)) // parts - (64 * p) // parts
        if size >= len(left):
            groups.append(left)
            break
        sub = corr[np.ix_(left, left)]
        group = [left[i] for i in np.unravel_index(np.argmax(sub), sub.shape)][:size]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def allot(costs: list[list[float]], gains: list[list[float]], need: float, steps: int) -> list[int]:
    """The option for each partition that reaches ``need`` in gain at least cost,
    by dynamic programming over gain in ``steps`` steps."""
    unit = need / steps
    best, choice = np.full(steps + 1, np.inf), []
    best[0] = 0
    for cost, gain in zip(costs, gains, strict=True):
        new, chosen = np.full(steps + 1, np.inf), np.zeros((steps + 1, 2), np.int64)
        for option, (c, g) in enumerate(zip(cost, gain, strict=True)):
            step = int(g / unit + 1e-9)
            for have in range(steps + 1):
                to = min(steps, have + step)
                if best[have] + c < new[to]:
                    new[to], chosen[to] = best[have] + c, (option, have)
        best = new
        choice.append(chosen)
    if not np.isfinite(best[steps]):
        raise ValueError("no allotment reaches the search's guarantee")
    at, out = steps, []
    for chosen in reversed(choice):
        out.append(int(chosen[at][0]))
        at = int(chosen[at][1])
    return out[::-1]


@dataclass
class Plan:
    """Partitions in use: (bit positions, threshold)."""

    parts: list[tuple[list[int], int]]


def meeting(width: int, t: int, d: float) -> float:
    """The chance that nodes whose bits differ with chance ``d`` have a key of their
    balls of radius t in common."""
    return sum(math.comb(width, i) * d**i * (1 - d) ** (width - i) for i in range(min(width, 2 * t) + 1))


def partitions(n: int, search: Search) -> int:
    """The partitions of a word that cost least for n nodes."""

    def cost(width: int, t: int, tables: float) -> float:
        filed = ball(width, t)
        return filed * tables * (1 + COMPARING * filed * n / 2.0**width)

    if search.radius is not None:
        each = {m: cost(64 // m, 0, m) if m > search.radius else cost(64 // m, search.radius // m, m) for m in range(1, search.radius + 2)}
    else:
        each = {}
        for m in (1, 2, 3, 4):
            width = 64 // m
            tables = [(t, math.log(search.miss) / math.log1p(-meeting(width, t, search.differ()))) for t in (0, 1)]
            each[m] = min(cost(width, t, x) if x <= m * search.bits // 64 else math.inf for t, x in tables)
    return min(each, key=each.get)


def plan(nodes: DataFrame, n: int, search: Search) -> Plan:
    words = search.bits // 64
    if search.radius is not None and search.radius > 2:
        raise ValueError("exact search is for a radius of up to 2 bits")
    m = partitions(n, search)
    together = co_occurrence(nodes, search.bits)
    parts = [[64 * k + b for b in g] for k in range(words) for g in group_bits(together[k], n, m)]
    pairs = [0.0] * len(parts)
    counted = keys(nodes, Plan([(p, 0) for p in parts]), search).groupBy("part", "bucket").count()
    for r in counted.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect():
        pairs[r["part"]] = r["pairs"]
    top = search.radius if search.radius is not None else 1
    costs, gains = [], []
    for p, own in zip(parts, pairs, strict=True):
        options = range(-1, min(top, len(p)) + 1)
        meet = lambda t, p=p, own=own: COMPARING * ball(len(p), t) ** 2 * max(own, n * n / 2.0 ** (len(p) + 1))
        costs.append([0.0 if t < 0 else ball(len(p), t) * n + meet(t) for t in options])
        if search.radius is not None:
            gains.append([float(t + 1) for t in options])
        else:
            gains.append([0.0 if t < 0 else -math.log1p(-meeting(len(p), t, search.differ())) for t in options])
    need, steps = (search.radius + 1, search.radius + 1) if search.radius is not None else (-math.log(search.miss), 400)
    chosen = allot(costs, gains, need, steps)
    return Plan([(p, c - 1) for p, c in zip(parts, chosen, strict=True) if c > 0])


# -- probing and verifying


def keys(nodes: DataFrame, made: Plan, search: Search) -> DataFrame:
    """(part, bucket, node, s0[, s1]): each node under all its keys, with its sketch.  A
    bucket's number is made from partition and key, one to one within a partition."""
    parts, words = made.parts, search.sketch()[0]
    names = ["part", "bucket", "node", *(f"s{w}" for w in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(len(node), -1)
            part, bucket = [], []
            for k, (positions, t) in enumerate(parts):
                key = np.zeros(len(x), np.uint64)
                for i, b in enumerate(positions):
                    key |= ((x[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(i)
                for r in range(t + 1):
                    for flips in itertools.combinations(range(len(positions)), r):
                        part.append(k)
                        bucket.append(widen(key ^ np.uint64(sum(1 << i for i in flips)), k + 1))
                at_end = k == len(parts) - 1
                if bucket and (at_end or len(bucket) * len(x) > 1 << 16):
                    n = len(bucket)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(part, np.int32), len(x))), pa.array(np.concatenate(bucket).view(np.int64)), pa.array(np.tile(node, n)), *(pa.array(np.tile(x[:, w].view(np.int64), n)) for w in range(words))], names=names)
                    part, bucket = [], []

    return nodes.select("node", "fp").mapInArrow(run, "part int, bucket bigint, node bigint, " + ", ".join(f"s{w} bigint" for w in range(words)))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of fingerprints: whether they link, and whether only their shingles can
    tell."""
    differ = apart(a, b)
    if search.radius is not None:
        return differ <= search.radius, np.zeros(len(differ), bool)
    words, most = search.sketch()
    made = rules(search.bits, search.similarity)
    least = np.minimum(na, nb)
    able = (least_common(na + nb, search.similarity) <= least) & (apart(a[:, :words], b[:, :words]) <= most)
    sure = able & (differ <= made.sure)
    return sure, able & ~sure & (differ <= np.array(made.most)[np.searchsorted(FEW, least, side="right")])


def at_home(a: np.ndarray, b: np.ndarray, bucket: np.ndarray, made: Plan) -> np.ndarray:
    """Of pairs of fingerprints that met in a bucket: whether it is that of the first
    partition, of those without flipped bits, in which their keys are equal.  So a pair
    that meets in many buckets is left open in one; one that meets only by flipped bits is
    in each."""
    home, found = np.ones(len(a), bool), np.zeros(len(a), bool)
    differ = a ^ b
    for k, (positions, t) in enumerate(made.parts):
        word = positions[0] // 64
        mask = np.uint64(sum(1 << (p % 64) for p in positions))
        first = ~found & ((differ[:, word] & mask) == 0) if not t else np.zeros(0, bool)
        if first.any():
            key = np.zeros(int(first.sum()), np.uint64)
            for i, p in enumerate(positions):
                key |= ((a[first, word] >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(i)
            home[first] = widen(key, k + 1).view(np.int64) == bucket[first]
            found |= first
    return home


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position linked to each of n positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within runs of the given sizes, some at a time."""
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    for size in np.unique(sizes):
        i, j = (x.astype(np.int32) for x in np.triu_indices(int(size), 1))
        at = begin[sizes == size]
        per = max(1, PAIRS // max(1, len(i)))
        for lo in range(0, len(at), per):
            for k in range(0, len(i), PAIRS):  # of a large run some pairs at a time
                yield (at[lo : lo + per, None] + i[k : k + PAIRS]).ravel(), (at[lo : lo + per, None] + j[k : k + PAIRS]).ravel()


def _across(sizes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the positions marked left with the others, within runs, some at a time."""
    for lo, hi in itertools.pairwise(np.concatenate([[0], np.cumsum(sizes)]).tolist()):
        i, j = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(~left[lo:hi])
        per = max(1, PAIRS // max(1, len(j)))
        for k in range(0, len(i) if len(j) else 0, per):
            own = i[k : k + per]
            yield np.repeat(own, len(j)), np.tile(j, len(own))


def _candidates(members: pa.ListArray, row: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs to compare in lists of nodes: all in a whole bucket (row -1), in a block its
    left nodes with its others; only nodes of different classes."""
    flat, offsets = members.flatten(), members.offsets.to_numpy()
    kind, left = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("class", "left"))
    whole = row.to_numpy(zero_copy_only=False) < 0
    for some, pairs in ((whole, lambda at, sizes: _pairs(sizes)), (~whole, lambda at, sizes: _across(sizes, left[at].astype(bool)))):
        if some.any():
            sizes = np.diff(offsets)
            at = np.flatnonzero(np.repeat(some, sizes))
            for a, b in pairs(at, sizes[some]):
                a, b = at[a], at[b]
                other = kind[a] != kind[b]
                yield a[other], b[other]


#: What comes of a list of nodes: links (a, b) that fingerprints settle, nodes a that are
#: open in a spot, links (a, b) that only long texts can settle.
SURE, OPEN, PAIR = 0, 1, 2
SPOT = ["bucket", "row", "col"]
FOUND = "kind int, a bigint, b bigint, bucket bigint, row int, col int, left boolean"


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lists (*SPOT, members) cut so that the lists of one have some PAIRS pairs,
    or are one list."""
    for batch in batches:
        sizes = np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64)
        part = np.cumsum(sizes * sizes) // (2 * PAIRS)
        for lo, hi in itertools.pairwise([*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(sizes)] if len(sizes) else []):
            yield batch.slice(lo, hi - lo)


def _found(kind: int, a: np.ndarray, b: np.ndarray | None = None, *spot: pa.Array) -> pa.RecordBatch:
    n, types = len(a), (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    spots = spot or [pa.nulls(n, t) for t in types]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), *spots], names=["kind", "a", "b", "bucket", "row", "col", "left"])


def _links_of(lists: DataFrame, made: Plan, search: Search) -> DataFrame:
    """FOUND of lists (*SPOT, members) of (node, fp, shingles, class, left): a spanning forest
    of the sure links, and what is open between different trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            members = batch.column(3)
            flat = members.flatten()
            node = flat.field("node").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(flat.field("fp").to_pylist()), "<u8").reshape(len(node), -1)
            n = flat.field("shingles").to_numpy(zero_copy_only=False).astype(np.float64)
            bucket = np.repeat(batch.column(0).to_numpy(), np.diff(members.offsets.to_numpy()))
            found, open_ = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
            for a, b in _candidates(members, batch.column(1)):
                ok, maybe = near(x[a], x[b], n[a], n[b], search)
                found.append(np.stack([a[ok], b[ok]]))
                a, b = a[maybe], b[maybe]
                here = at_home(x[a], x[b], bucket[a], made)
                open_.append(np.stack([a[here], b[here]]))
            root = forest(len(node), *np.concatenate(found, axis=1))
            own = np.flatnonzero(root != np.arange(len(node)))
            if len(own):
                yield _found(SURE, node[own], node[root[own]])
            a, b = np.concatenate(open_, axis=1)
            other = root[a] != root[b]
            a, b = a[other], b[other]
            long = np.maximum(n[a], n[b]) > LONG
            if long.any():
                yield _found(PAIR, node[a[long]], node[b[long]])
            own = np.unique(np.concatenate([a[~long], b[~long]]))
            if len(own):
                row = pa.array(np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy()))[own])
                yield _found(OPEN, node[own], None, *(batch.column(k).take(row) for k in range(3)), flat.field("left").take(pa.array(own)))

    return lists.select(*SPOT, "members").mapInArrow(run, FOUND)


def _within_radius(lists: DataFrame, search: Search) -> DataFrame:
    """Edges (a, b) of an exact search in lists of (node, s0): a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            node, x = (members.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("node", "s0"))
            x, found = x.view(np.uint64), [np.zeros((2, 0), np.int64)]
            for a, b in _pairs(np.diff(members.offsets.to_numpy())):
                ok = np.bitwise_count(x[a] ^ x[b]) <= search.radius
                found.append(np.stack([a[ok], b[ok]]))
            root = forest(len(node), *np.concatenate(found, axis=1))
            own = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])

    return lists.select("members").mapInArrow(run, "a bigint, b bigint")


def _promising(lists: DataFrame, search: Search) -> DataFrame:
    """(*SPOT, node, class, left) of list members whose sketch is near that of a node they
    are to be compared with; nodes that share a bucket by chance hardly ever are."""
    words, most = search.sketch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            members = batch.column(3)
            flat = members.flatten()
            x = np.stack([flat.field(f"s{w}").to_numpy(zero_copy_only=False) for w in range(words)], axis=1).view(np.uint64)
            keep = np.zeros(len(x), bool)
            for a, b in _candidates(members, batch.column(1)):
                ok = apart(x[a], x[b]) <= most
                keep[a[ok]] = keep[b[ok]] = True
            row = pa.array(np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy()))[keep])
            if len(row):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(3)), *(flat.field(c).filter(pa.array(keep)) for c in ("node", "class", "left"))], names=[*SPOT, "node", "class", "left"])

    return lists.select(*SPOT, "members").mapInArrow(run, "bucket bigint, row int, col int, node bigint, class bigint, left boolean")


def links(nodes: DataFrame, made: Plan, search: Search, scope: Scope, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """FOUND of nodes (node, fp, shingles) in their buckets.  In an exact search all of it
    is sure; the components of the links (a, b) are those of all links."""
    filed = keys(nodes, made, search).drop("part")
    large = scope.table(filed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "large")
    # buckets with many of all rows leave before the shuffle
    hot = hot_keys(large, "bucket", nodes.count() * sum(ball(len(p), t) for p, t in made.parts))
    is_hot = F.col("bucket").isin(hot) if hot else F.lit(False)
    rest, mid = filed.where(~is_hot), large.where(~is_hot)
    sketch = [c for c in filed.columns if c not in ("bucket", "node")]
    few = rest.join(mid, "bucket", "left_anti").groupBy("bucket").agg(F.collect_list(F.struct("node", *sketch)).alias("members")).where(F.size("members") > 1)
    many = filed.where(is_hot).join(F.broadcast(large.where(is_hot)), "bucket").unionByName(rest.join(mid, "bucket"))
    if search.radius is not None:
        edges = _within_radius(few, search)
        if large.isEmpty():
            return edges
        # nodes within 2 bits meet at a point within 1 bit of both; at most 65 nodes meet at one
        points = _points(many.select("node", "s0").distinct())
        stars = points.groupBy("point").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
        return edges.unionByName(stars.select("a", F.explode("all").alias("b")).where("a != b"))
    whole = F.transform("members", lambda m: F.struct(m["node"].alias("node"), *[m[c].alias(c) for c in sketch], m["node"].alias("class"), F.lit(False).alias("left")))
    few = few.select("bucket", F.lit(-1).alias("row"), F.lit(-1).alias("col"), whole.alias("members"))
    found = _verified(_promising(few, search), nodes, made, search)
    if large.isEmpty():
        return found
    many = scope.table(many, "many")
    led = scope.table(_led(many, nodes, search, block), "led")
    blocks = _blocks(many, _classes(led), block)
    return found.unionByName(led.withColumn("kind", F.lit(SURE)), allowMissingColumns=True).unionByName(_verified(_promising(blocks, search), nodes, made, search))


def _verified(met: DataFrame, nodes: DataFrame, made: Plan, search: Search) -> DataFrame:
    """FOUND among the nodes that met at each spot."""
    member = F.struct("node", "fp", "shingles", "class", "left")
    return _links_of(met.join(nodes.select("node", "fp", "shingles"), "node").groupBy(SPOT).agg(F.collect_list(member).alias("members")), made, search)


def _led(many: DataFrame, nodes: DataFrame, search: Search, block: int) -> DataFrame:
    """Sure edges (a, b) of the nodes of large buckets with ``LEADERS`` of the largest one
    that each is in: a large group of near copies is soon of one class."""
    member = F.struct("node", "fp", "shingles")
    parts = F.ceil(F.col("n") / block).cast("int")
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("node"))
    leaders = many.withColumn("at", F.row_number().over(order)).where(F.col("at") <= LEADERS).join(nodes, "node")
    leaders = leaders.groupBy("bucket").agg(F.collect_list(member).alias("leaders"), F.max(parts).alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    home = many.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("home")).select("node", "home.n", "home.bucket")
    home = home.join(nodes, "node").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    return _against(home.join(leaders, ["bucket", "part"]), search)


def _classes(led: DataFrame) -> DataFrame:
    """(node, component): the smallest leader that a node links to, or the smallest that
    this one does.  Nodes of one class are connected; not all that are need be of one."""
    own = led.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("leader"))
    over = own.select(F.col("node").alias("leader"), F.col("leader").alias("next"))
    return own.join(over, "leader", "left").select("node", F.least("leader", "next").alias("component"))


def _blocks(many: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """(bucket, row, col, members) of large buckets: the nodes outside a bucket's largest
    class by all its nodes, in blocks, so that each pair of nodes of different classes
    meets in one.  The work is quadratic only in the nodes that link to no class."""
    rows = many.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component", "n")
    per = rows.groupBy("bucket", "class").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("top"), F.sum("n").alias("n"))
    size = lambda c: F.ceil(c / block).cast("int")
    per = per.where("n > top").select("bucket", "main", size(F.col("n") - F.col("top")).alias("rows"), size(F.col("n")).alias("cols"))
    met = rows.join(per, "bucket")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda row, col, left: F.struct(row.alias("row"), col.alias("col"), F.lit(left).alias("left"))
    across = F.transform(each("rows"), lambda r: place(r, own("cols"), False))
    down = F.when(F.col("class") != F.col("main"), F.transform(each("cols"), lambda c: place(own("rows"), c, True))).otherwise(F.array().cast("array<struct<row:int,col:int,left:boolean>>"))
    dealt = met.withColumn("place", F.explode(F.concat(across, down)))
    sketch = [c for c in many.columns if c not in ("bucket", "node", "n")]
    return dealt.groupBy("bucket", F.col("place.row").alias("row"), F.col("place.col").alias("col")).agg(F.collect_list(F.struct("node", *sketch, "class", F.col("place.left").alias("left"))).alias("members"))


def _against(rows: DataFrame, search: Search) -> DataFrame:
    """Sure edges (a, b) of each node with its row's leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            node, theirs = (c.to_numpy(zero_copy_only=False) for c in (batch.column(0), flat.field("node")))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u8").reshape(-1, search.bits // 64) for c in (batch.column(1), flat.field("fp")))
            n, m = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (batch.column(2), flat.field("shingles")))
            own = np.repeat(np.arange(len(node)), sizes)
            ok = near(x[own], y, n[own], m, search)[0] & (node[own] != theirs)
            yield pa.RecordBatch.from_arrays([pa.array(node[own[ok]]), pa.array(theirs[ok])], names=["a", "b"])

    return rows.select("node", "fp", "shingles", "leaders").mapInArrow(run, "a bigint, b bigint")


def _points(nodes: DataFrame) -> DataFrame:
    """(node, point): a 64-bit fingerprint and all that differ from it in one bit."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, 65)), pa.array((x[:, None] ^ flips).ravel().view(np.int64))], names=["node", "point"])

    return nodes.mapInArrow(run, "node bigint, point bigint")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the different shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or "", words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, hashes array<bigint>")


def _sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, scope: Scope) -> DataFrame:
    """(node, hashes) of the wanted nodes, from the text of each one's first row."""
    asked = scope.table(wanted.distinct().join(nodes, "node").select("node", "first.*").fillna(0, ["doc_id"]), "asked")
    texts = keyed(docs).withColumn("none", F.col("doc_id").isNull()).fillna(0, ["doc_id"]).join(small(asked), ["none", "doc_id", "text_key"])
    return scope.table(_shingle_sets(texts.dropDuplicates(["node"]), words), "sets")


def _settled(lists: DataFrame, made: Plan, search: Search) -> DataFrame:
    """Edges (a, b) of lists (*SPOT, members) of (node, fp, shingles, class, left, hashes): of
    the pairs of different classes that only shingles can tell, the nearest first, those
    that link and connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            members = batch.column(3)
            flat = members.flatten()
            node = flat.field("node").to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(flat.field("fp").to_pylist()), "<u8").reshape(len(node), -1)
            n = flat.field("shingles").to_numpy(zero_copy_only=False).astype(np.float64)
            bucket = np.repeat(batch.column(0).to_numpy(), np.diff(members.offsets.to_numpy()))
            hashes, cuts = flat.field("hashes").flatten().to_numpy(zero_copy_only=False), flat.field("hashes").offsets.to_numpy()
            # of one class or one node: of one tree from the start
            root = np.unique(flat.field("class").to_numpy(zero_copy_only=False), return_inverse=True)[1].tolist()

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            trees = {}
            root[:] = [trees.setdefault(r, i) for i, r in enumerate(root)]
            out = []
            for a, b in _candidates(members, batch.column(1)):
                maybe = near(x[a], x[b], n[a], n[b], search)[1]
                a, b = a[maybe], b[maybe]
                here = at_home(x[a], x[b], bucket[a], made)
                a, b = a[here], b[here]
                order = np.argsort(apart(x[a], x[b]), kind="stable")
                for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                    u, v = find(i), find(j)
                    if u == v:
                        continue
                    first, second = hashes[cuts[i] : cuts[i + 1]], hashes[cuts[j] : cuts[j + 1]]
                    common = len(np.intersect1d(first, second, assume_unique=True))
                    if common + 1e-9 >= search.similarity * (len(first) + len(second) - common):
                        root[max(u, v)] = min(u, v)
                        out.append((node[i], node[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(out, np.int64).T], names=["a", "b"])

    return lists.select(*SPOT, "members").mapInArrow(run, "a bigint, b bigint")


def _settled_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets have the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in ("a", "b"))
    common = F.size(F.array_intersect("a_hashes", "b_hashes"))
    joint = F.size("a_hashes") + F.size("b_hashes") - F.col("common")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), "a_hashes", "b_hashes")
    return both.where(F.col("common") + 1e-9 >= similarity * joint).select("a", "b")


def _components(found: list[tuple[DataFrame, Plan, Search]], docs: DataFrame, nodes: DataFrame, words: int, scope: Scope) -> DataFrame:
    """(node, component) by what the searches found: sure links make classes, and what is
    open between classes is settled by shingles."""
    sure = found[0][0].where(f"kind = {SURE}").select("a", "b")
    for more, *_ in found[1:]:
        sure = sure.unionByName(more.where(f"kind = {SURE}").select("a", "b"))
    classes = components(sure, scope=scope)

    def with_class(rows: DataFrame, column: str, name: str) -> DataFrame:
        own = classes.select(F.col("node").alias(column), F.col("component").alias(name))
        return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))

    met, pairs = [], None
    for each, made, search in found:
        held = with_class(each.where(f"kind = {OPEN}").select(F.col("a").alias("node"), *SPOT, "left"), "node", "class")
        mixed = held.groupBy(SPOT).agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select(SPOT)
        met.append((scope.table(held.join(mixed, SPOT), "open"), made, search))
        own = with_class(with_class(each.where(f"kind = {PAIR}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "a", "in_a"), "b", "in_b").where("in_a != in_b").select("a", "b")
        pairs = own if pairs is None else pairs.unionByName(own)
    pairs = scope.table(pairs.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    for rows, *_ in met:
        wanted = wanted.unionByName(rows.select("node"))
    if wanted.isEmpty():
        return classes
    sets = _sets_of(wanted, docs, nodes, words, scope)
    edges = classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_settled_pairs(pairs, sets, met[0][2].similarity))
    member = F.struct("node", "fp", "shingles", "class", "left", "hashes")
    for rows, made, search in met:
        lists = rows.join(nodes.select("node", "fp", "shingles").join(sets, "node"), "node").groupBy(SPOT).agg(F.collect_list(member).alias("members"))
        edges = edges.unionByName(_settled(lists, made, search))
    return components(edges, scope=scope)


def _first():
    """Of rows with one fingerprint the first: by doc_id, null last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))).alias("first")


def near_duplicates(docs: DataFrame, words: int = 3, search: Search | None = None, distinct: bool = False) -> DataFrame:
    """(doc_id, text_key, fp, shingles, component_id, kept) of each row; a component is
    named by its smallest doc_id and keeps its first row."""
    search, spark = search or Search(), docs.sparkSession
    kept_on = Scope(spark, later=True)
    marks = kept_on.table(fingerprints(docs, words, search.bits, distinct or search.radius is None), "marks")
    nodes = marks.groupBy("fp").agg(_first(), F.max("shingles").alias("shingles"), F.count("*").alias("rows"))
    nodes = kept_on.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, total = nodes.agg(F.count("*"), F.sum("rows")).first()
    scope = Scope(spark)
    if not n:
        return marks.withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True)})
    if search.radius is not None:
        found = components(links(nodes, plan(nodes, n, search), search, scope), scope=scope)
    else:
        each = []
        for most, lane in lanes(search):
            own = nodes if most is None else nodes.where(F.col("shingles") <= most)
            count = n if most is None else own.count()
            if count > 1 or most is None:
                made = plan(own, count, lane)
                each.append((scope.table(links(own, made, lane, scope), "links"), made, lane))
        found = _components(each, docs, nodes, words, scope)
    named = kept_on.table(_named(nodes, found, n), "named")
    scope.close()
    hot = hot_keys(nodes.withColumnRenamed("rows", "n"), "fp", total)
    rows = looked_up(marks, named, "fp", hot)
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_key") == F.col("keep.text_key"))
    return rows.select("doc_id", "text_key", "fp", "shingles", F.col("keep.doc_id").alias("component_id"), kept.alias("kept"))


def _named(nodes: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(fp, keep) of each node: the first row of its component."""
    placed = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("first").alias("keep"), F.count("*").alias("members"))
    hot = hot_keys(names.withColumnRenamed("members", "n"), "component", n)
    return looked_up(placed.select("component", "fp"), names.drop("members"), "component", hot).select("fp", "keep")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 1024) -> DataFrame:
    """``docs`` with the row of smallest doc_id of each near-duplicate group; rows equal in
    doc_id and text stay or go together."""
    found = near_duplicates(docs, words, Search(bits=bits, radius=None, similarity=similarity), distinct=True)
    none, key, tk = (fresh(docs, c) for c in ("no_id", "id_key", "text_key"))
    lost = found.where(~F.col("kept")).select(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(key), F.col("text_key").alias(tk)).distinct()
    own = F.col("doc_id").cast("bigint")
    rows = docs.withColumns({none: own.isNull(), key: F.coalesce(own, F.lit(0)), tk: F.xxhash64("text")})
    return rows.join(small(Scope(docs.sparkSession, later=True).table(lost, "lost")), [none, key, tk], "left_anti").select(docs.columns)
