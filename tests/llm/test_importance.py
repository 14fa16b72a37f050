"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlake.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in plain_features(x):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, n = [], 0
    for doc_id, x in docs:
        f = plain_features(x)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(k)] for k in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= least])
    n = sum(r[-1] for r in out) * percent // 100
    best = sorted((r for r in out if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[:n]
    rank = {id(r): k for k, r in enumerate(best, 1)}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ0 .é世\U0001f600-_\n", max_size=120) | st.just("x" * 300 + " y"), max_size=8))
def test_features_of_bytes_are_those_of_text(texts):
    column = pa.array(["skipped", *texts])[1:]
    found = {i: [] for i in range(len(texts))}
    for row, bucket in importance.features(column):
        for r, b in zip(row.tolist(), bucket.tolist()):
            found[r].append(b)
    for i, text in enumerate(texts):
        assert found[i] == [zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)]


def test_the_query_is_a_plain_computation(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain(docs, target)
    assert got(queries.op11_importance_resampling(spark, sf)) == want
    assert sum(r[-1] is not None for r in want) > 5


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_hard_negatives", "op13_substring_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf).select(*want.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))


def test_odd_rows(spark):
    long = "Wort " * 30_000
    rows = [(1, None, "a"), (2, "", "b"), (3, long, "c"), (4, "x" * 200_000, "d"), (5, "eins zwei " * 10, "e"), (5, "eins zwei " * 10, "e"), (None, "drei 世界 " * 12, "f"), (7, "... !!", "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rank string")
    target = spark.createDataFrame([("eins zwei",), (None,)], "text string")
    assert got(importance.resample(df, target, percent=70)) == plain([r[:2] for r in rows], ["eins zwei", None], 70)


@pytest.mark.parametrize("empty", ["docs", "target"])
def test_empty_tables(spark, empty):
    rows = [] if empty == "docs" else [(k, "ein kurzer Text " * 9) for k in range(40)]
    target = [] if empty == "target" else ["ein Text"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=50)) == plain(rows, target, 50)


def test_draws_towards_the_target(spark):
    like = "rare stellar spectra of the distant halo "
    rows = [(k, (like if k % 4 == 0 else "common kitchen recipes with plenty of salt ") * 4) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    drawn = importance.resample(df, spark.createDataFrame([(like,)], "text string"), percent=20).where("rank IS NOT NULL").collect()
    assert len(drawn) == 80 and all(r["doc_id"] % 4 == 0 for r in drawn)
