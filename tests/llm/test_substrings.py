"""Repeated passages against a plain search of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rosterlake.llm import queries, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs):
    """docs: (doc_id, text) of different ids, or equal rows."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first, out = {}, {}
    for d in sorted(words, key=lambda d: (d is None, d or 0)):
        gone = [False] * len(words[d])
        for i in range(len(words[d]) - 19):
            if first.setdefault(tuple(words[d][i : i + 20]), (d, i)) != (d, i):
                gone[i : i + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words[d], gone) if not g)
        out[d] = (d, len(words[d]), sum(gone), kept)
    return sorted((out[d] for d, _ in docs), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, n=60, size=90, words=400):
    """Texts of passages that repeat whole, in part, one word off, and within a text."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(words)}"
    passages = [[word() for _ in range(rng.randrange(12, 70))] for _ in range(8)]
    out = []
    for k in range(n):
        text = [word() for _ in range(rng.randrange(size))]
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            lo, hi = sorted(rng.sample(range(len(p) + 1), 2))
            p = p[lo:hi] if rng.random() < 0.5 else p
            if p and rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            at = rng.randrange(len(text) + 1)
            text[at:at] = p * rng.choice((1, 1, 1, 2))
        out.append((k * 3 - 20, rng.choice((" ", "\n", "\t ")).join(text)))
    return out


SCHEMA = "doc_id bigint, text string, words string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def test_the_query_is_a_plain_search(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain(docs)
    assert sum(r[2] for r in want) > 100
    hashed = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in want), key=str)
    assert got(queries.op13_substring_dedup(spark, sf)) == hashed


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_all_kinds(spark, seed, monkeypatch):
    rows = texts(seed)
    assert got(substrings.without_repeats(frame(spark, rows))) == plain(rows)
    for name, value in (("REFERENCES", 20), ("CITING", 7), ("HOT", 50), ("HOT_ROWS", 3)):
        monkeypatch.setattr(substrings, name, value)
    assert got(substrings.without_repeats(frame(spark, rows))) == plain(rows)


def test_few_words_make_many_matches(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60, 200)))) for k in range(12)] + [(90, "a " * 300), (91, "a " * 19), (92, "b " * 20)]
    assert got(substrings.without_repeats(frame(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, "y" * 200_000), (6, " \x00a \x1fb\x0b\x0c " * 30), (None, long), (-7, "世界 é " * 40)]
    assert got(substrings.without_repeats(frame(spark, rows))) == plain(rows)
    # equal rows are one document
    again = rows + [rows[2], rows[3], rows[6]]
    assert got(substrings.without_repeats(frame(spark, again))) == plain(again)
    assert got(substrings.without_repeats(frame(spark, []))) == []


def test_one_id_with_two_texts_is_two_documents(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, passage + " a"), (1, passage + " b"), (2, passage)]
    found = got(substrings.without_repeats(frame(spark, rows)))
    assert sorted(r[2] for r in found) == [0, 40, 40]


def test_many_copies(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{k} {passage} end{k}") for k in range(3000)] + [(k, f"u{k} " * 30) for k in range(3000, 3100)]
    assert got(substrings.without_repeats(frame(spark, rows))) == plain(rows)


def test_equal_windows_have_equal_anchors():
    rows = texts(9, 40)
    column = pa.array([t for _, t in rows])
    row, at, found = substrings.anchors(column)
    of = {}
    for r, a, h in zip(row.tolist(), at.tolist(), found.tolist()):
        of.setdefault(r, []).append((a, h))
    seen = {}
    for r, (_, text) in enumerate(rows):
        words = text.split()
        for i in range(len(words) - 19):
            inside = [(h, a - i) for a, h in of[r] if i <= a <= i + 10]
            assert inside
            assert seen.setdefault(tuple(words[i : i + 20]), min(inside)) == min(inside)
            assert len(np.unique([h for h, _ in inside])) >= 1
