"""Document quality by compression.

Two zstandard dictionaries are built from labelled text, one good, one bad.  A
text is cut into blocks of ``BLOCK`` bytes, each compressed with either
dictionary, and with the summed sizes g and b the feature is (b - g) / (b + g).
Blocks keep a long text from teaching the compressor its own style, so the
dictionaries decide over the whole text.  A logistic curve, fitted on labelled
rows that made no dictionary, turns the feature into a score.

The fit takes a bounded sample: of each class at most ``SAMPLE`` labelled rows,
those of smallest hash of doc_id (of rows that repeat one, that of smallest hash of the
text), and of each at most ``WINDOW`` characters, those of a longer text in parts that are
spread evenly over its whole length; with ``window=None`` it takes these texts whole.
Scoring reads every text whole.

Defined cases: null text is the empty text, whose feature is 0; without labels of
both classes the score is the share of label 1 (0.5 without any); a label that is
null or not 0 or 1 is left out, of repeated labels of a doc_id the smaller
counts; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

#: Labelled rows of a class, and characters of a row, that a fit may take.
SAMPLE, WINDOW = 4000, 8192
#: Characters of a part.
PART = 1024
DICTIONARY, LEVEL, BLOCK = 256 << 10, 3, 256
#: Score from which a document counts as good.
CUT = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    @functools.cached_property
    def compressors(self) -> tuple:
        return tuple(_compressor(d) for d in (self.good, self.bad))

    def feature(self, text: str) -> float:
        raw = text.encode("utf-8", "replace")
        if not raw or not self.good or not self.bad:
            return 0.0
        good, bad = self.compressors
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        g, b = sum([len(good.compress(x)) for x in blocks]), sum([len(bad.compress(x)) for x in blocks])
        return (b - g) / (b + g)

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.feature(t) for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30)))


def _compressor(raw: bytes):
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def build_dictionary(texts: list[str], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or where there is too little text for training the
    text itself as content."""
    parts = [raw[i : i + 1024] for raw in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(raw), 1024)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, parts)) // 4)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[:size]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton steps, on a scale where x has spread 1."""
    scale = float(x.std()) or 1.0
    design, w = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def may_learn(doc_id: Column) -> Column:
    """Rows that a fit may see: crc32 of the doc_id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def sampled(text: Column, window: int | None) -> Column:
    """A text of at most ``window`` characters, or as many of it in even parts; whole
    without a window."""
    if window is None:
        return text
    size = min(PART, window)
    parts = max(1, window // size)
    step = (F.char_length(text) - size) / max(1, parts - 1)
    some = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.char_length(text) <= window, text).otherwise(F.array_join(some, ""))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, window: int | None = WINDOW) -> Model:
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(may_learn(F.col("doc_id")))
    picked = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # a row an id, so 2 * sample rows at most; the texts that go are cut before they move
    one = texts.select("doc_id", "quality", sampled(F.col("text"), window).alias("text"), F.xxhash64("text").alias("h"))
    rows = one.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct("h", "text")).alias("text")).collect()
    by = {k: [r["text"] for r in sorted((r for r in rows if r["quality"] == k), key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["text"]))] for k in (0, 1)}
    total = len(by[0]) + len(by[1])
    if not by[0] or not by[1]:
        share = len(by[1]) / total if total else 0.5
        return Model(b"", b"", 0.0, float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))
    # two thirds make the dictionaries, the rest the curve
    first = {k: by[k][: max(1, 2 * len(by[k]) // 3)] for k in by}
    rest = {k: by[k][len(first[k]) :] or by[k] for k in by}
    model = Model(build_dictionary(first[1]), build_dictionary(first[0]), 0.0, 0.0)
    x = np.array([model.feature(t) for k in (0, 1) for t in rest[k]])
    y = np.array([k for k in (0, 1) for _ in rest[k]], np.float64)
    # the sample is balanced where the corpus is not; the curve keeps the corpus's odds
    odds = known.groupBy("quality").count().collect()
    counts = {r["quality"]: r["count"] for r in odds}
    slope, intercept = logistic(x, y)
    shift = np.log(counts[1] / counts[0]) - np.log(len(rest[1]) / len(rest[0]))
    return Model(model.good, model.bad, slope, intercept + float(shift))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in text]), dtype="float64")

    return docs.withColumn(name, score(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, unchanged."""
    name = fresh(docs, "score")
    return with_score(docs, fit(docs, labels), name).where(F.col(name) >= cut).drop(name)
