"""Hash embeddings and cosine similarity."""

from __future__ import annotations

import hashlib
import importlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedding_text(title: Column, abstract: Column) -> Column:
    """What of a work is embedded: title, a separator, 1,024 characters of abstract."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" [SEP] "), F.substring(F.coalesce(abstract, F.lit("")), 1, 1024)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def hash_components(rows: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, value): the whole-number components, before scaling, that are
    not zero.  Words are hashed and added up where a row lies; what is shuffled is an array a
    row at most, as rows of one key count together."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(np.diff(batch.column(1).offsets.to_numpy()), AT_ONCE // 8):
                some, keys = batch.column(1)[lo:hi], batch.column(0)[lo:hi].dictionary_encode(null_encoding="encode")
                x = hash_sums(some.flatten(), np.repeat(keys.indices.to_numpy(), np.diff(some.offsets.to_numpy())), len(keys.dictionary), dim)
                yield pa.RecordBatch.from_arrays([keys.dictionary, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.astype(np.int64).ravel()))], names=[key, "sums"])

    own = rows.select(key, words(F.col(text)).alias("words")).where(F.size("words") > 0).mapInArrow(run, f"`{key}` {kind}, sums array<bigint>")
    added = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    whole = own.groupBy(key).agg(F.collect_list("sums").alias("all")).select(key, F.posexplode(added).alias("bucket", "value"))
    return whole.where("value != 0")


#: Characters of text, about, whose words are hashed at once.
AT_ONCE = 1 << 20


def hash_sums(words: pa.StringArray, row: np.ndarray, n: int, dim: int) -> np.ndarray:
    """n x dim: the whole-number components of n texts, whose words, each with its row, come
    in one list.  Different words are hashed once."""
    coded = words.dictionary_encode()
    digests = np.frombuffer(b"".join([hashlib.sha256(w.encode()).digest() for w in coded.dictionary.to_pylist()]), np.uint8).reshape(-1, 8, 4)
    bucket = (digests.view(">u4")[:, :, 0] % dim).astype(np.int64)
    sign = 1.0 - 2 * (digests[:, :, 0] % 2)
    code = coded.indices.to_numpy()
    at = row[:, None] * dim + bucket[code]
    return np.bincount(at.ravel(), weights=sign[code].ravel(), minlength=n * dim).astype(np.float64, copy=False).reshape(n, dim)


def _hash_embed_texts(texts: list[str], dim: int) -> np.ndarray:
    """Texts' unit vectors, zero without words.  Sums are of whole numbers, so their
    order does not matter."""
    words = [t.lower().split() for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    sums = hash_sums(pa.array(list(itertools.chain.from_iterable(words)), pa.large_string()), row, len(texts), dim)
    size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)


def hash_embed_text(text: str, dim: int) -> np.ndarray:
    return _hash_embed_texts([text], dim)[0]


def pieces(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Where to cut rows of these lengths so that a piece has about ``most`` in all; a row
    stays whole."""
    ends, out, lo = np.cumsum(lengths), [], 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def hash_embed(rows: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, embedding): unit vectors; a text without words has the zero vector.  One
    pass in Arrow batches; ``hash_components`` is the same sums of words as Spark tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for lo, hi in pieces(lengths, AT_ONCE):
                x = _hash_embed_texts([t or "" for t in batch.column(1)[lo:hi].to_pylist()], dim)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))], names=[key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def by_ids(stored: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Vectors of the works in a list or a table of work_id; of none for none."""
    if isinstance(ids, list):
        return stored.where(F.col("work_id").isin(ids)) if ids else stored.where(F.lit(False))
    return stored.join(ids.select("work_id").distinct(), "work_id", "left_semi")


def dense_embed(rows: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> DataFrame:
    """(key, embedding) by an encoder that the caller brings: ``make`` loads it, once a
    task, and it turns a list of texts into rows of ``dim`` numbers, which are scaled to
    unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encode = encode or make()
            x = np.asarray(encode([t or "" for t in batch.column(1).to_pylist()]), np.float64)
            if x.shape != (batch.num_rows, dim):
                raise ValueError(f"the encoder gave {x.shape} for {batch.num_rows} texts of {dim} dimensions")
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))], names=[key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def encoder(backend: str, encoders: dict[str, Callable] | None = None) -> Callable:
    """What loads an encoder: one of the caller's by name, or ``module:function``."""
    if backend in (encoders or {}):
        return encoders[backend]
    module, colon, name = backend.partition(":")
    if not colon:
        raise ValueError(f"no embedding backend {backend}; there are {', '.join(['hash', *(encoders or {})])} and module:function")
    return getattr(importlib.import_module(module), name)


def embed(rows: DataFrame, key: str, text: str, backend: str, dim: int, encoders: dict[str, Callable] | None = None) -> DataFrame:
    """(key, embedding) by the named backend: "hash", or an ``encoder``."""
    return hash_embed(rows, key, text, dim) if backend == "hash" else dense_embed(rows, key, text, encoder(backend, encoders), dim)


def hash_embed_one(text: str, dim: int) -> list[float]:
    """The same for one text on the driver, such as a query."""
    return hash_embed_text(text, dim).tolist()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is null, empty or zero or the lengths differ."""
    size = norm(a) * norm(b)
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(fits, dot(a, b) / size).otherwise(0.0)


def cosine_to(vector: list[float]):
    """Cosine against one vector, a batch at a time by matrix product: the faster
    form where a query is known on the driver."""
    q = np.asarray(vector, np.float64)
    length = float(np.sqrt((q * q).sum()))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column))
        fits = np.array([v is not None and len(v) == len(q) and len(q) > 0 for v in column])
        if fits.any() and length:
            x = np.stack([np.asarray(v, np.float64) for v, ok in zip(column, fits, strict=True) if ok])
            sizes = np.sqrt((x * x).sum(axis=1))
            out[fits] = np.divide(x @ q, sizes * length, out=np.zeros(len(x)), where=sizes > 0)
        return pd.Series(out)

    return score
