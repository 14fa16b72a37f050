import io
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlake.llm import bpe, queries, seekable, tokens

LIBRARY = Tokenizer.from_file(tokens.default_path())
ODD = ["", "it's  'S we'LL x\x1cy\x85z", "<|endoftext|>a b<|startoftext|>", "İstanbul ΣΑΣ ß ﬁ ñ ñ é", "日本 語 12ab ٣ " + "x" * 300, "a\tb\r\nc  d", "don't. a.b it’s", ".\"'s x--'t", "ª º ² ½ × ÷", "a​b ﻿q", "aaaa abab" * 30, "\x00\x01 \x7f", "a<|endoftext|", "y" * 5000]
# letters added to Unicode after the library's tables would differ in case
TEXT = st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_memo_equals_library_on_odd_texts():
    e = tokens.WordEncoder(tokens.default_path(), memo_words=5)
    for _ in range(3):
        assert [np.frombuffer(o, "<u4").tolist() for o in e.encode(ODD)] == [ids_of(t) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_both_encoders_equal_the_library(texts):
    want = [ids_of(t) for t in texts]
    assert [np.frombuffer(o, "<u4").tolist() for o in tokens.encoder(tokens.default_path()).encode(texts)] == want
    assert [np.frombuffer(o, "<u4").tolist() for o in bpe.vocabulary(tokens.default_path()).encode(texts)] == want


def test_letters_of_all_unicode_versions_equal_the_library():
    """Letters that are newer than Python's tables, their neighbours, and one in 97 of all."""
    near = {c + k for lo, hi, *_ in [*bpe.LATER_LETTERS, *bpe.LATER_CAPITALS] for c in range(lo, hi + 1) for k in (-2, -1, 0, 1, 2)}
    texts = [f"a{chr(c)}b {chr(c)}" for c in sorted(near | set(range(0, 0x110000, 97))) if not 0xD800 <= c < 0xE000]
    got = bpe.Vocabulary(tokens.default_path()).encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [ids_of(t) for t in texts]


def test_bpe_on_odd_texts_and_decoding():
    v = bpe.Vocabulary(tokens.default_path())
    for text, ids in zip(ODD, v.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)
        assert v.decode(ids) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)
    assert v.restore(v.encode(["Hello, wörld 12"])[0]) == "hello , wörld 1 2"
    assert v.encode([]) == [] and v.decode(b"") == ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abeinst'h é世", min_size=1, max_size=80), st.integers(1, 40))
def test_a_queue_gives_what_rounds_give(text, times):
    v = bpe.vocabulary(tokens.default_path())
    words = [w for w in v.words(text * times) if isinstance(w, str)]
    assert [v._merge_long(w.encode()) for w in words] == v._merge([w.encode() for w in words]) if words else True


def test_very_long_words_equal_the_library_and_take_little_time():
    rng = np.random.default_rng(3)
    v = bpe.Vocabulary(tokens.default_path())
    began = time.process_time()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu", "ab"):
        word = "".join(rng.choice(list(letters), 60_000))
        assert np.frombuffer(v.encode([word])[0], "<u4").tolist() == ids_of(word)
    assert time.process_time() - began < 20


def test_one_merge_at_a_time_gives_the_same():
    v = bpe.Vocabulary(tokens.default_path())
    assert v.all_at_once
    words = ["aaaaaaa", "banana", "mississippi", "x", "abababab"]
    fast = v.encode_words(words)
    v.all_at_once = False
    assert v.encode_words(words) == fast


def test_bpe_query(spark, sf):
    out = queries.op6_bpe(spark, sf).toPandas().set_index("doc_id")
    import hashlib

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(out)
    for r in rows:
        ids = ids_of(r["text"] or "")
        own = out.loc[r["doc_id"]]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# -- files


def write(docs, frame_ids=8):
    sink = io.BytesIO()
    w = seekable.Writer(sink, frame_ids)
    for key, ids in docs:
        w.put(key, np.array(ids, "<u4").tobytes())
    w.close()
    return sink.getvalue(), w


DOCS = [(None, [1]), (1, [5, 6]), (2, []), (2, [7] * 20), (9, [2, 3, 4])]


def test_round_trip_and_single_documents():
    raw, w = write(DOCS)
    r = seekable.Reader(io.BytesIO(raw), len(raw))
    assert [(k, np.frombuffer(i, "<u4").tolist()) for _, k, i in r.read()] == DOCS
    assert len(w.frames) == 3  # the long document fills a frame alone
    opened = []
    whole = r.frame
    r.frame = lambda k: opened.append(k) or whole(k)
    assert [np.frombuffer(i, "<u4").tolist() for _, _, i in r.read(r.find(9))] == [[2, 3, 4]]
    assert opened == [2]
    assert r.find(2) == [2, 3] and r.find(1) == [1] and r.find(0) == r.find(5) == r.find(10) == []


def test_ordinary_decoder_passes_over_the_table():
    import zstandard

    raw, _ = write(DOCS)
    held = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(held, "<u4").tolist() == [x for _, ids in DOCS for x in ids]


def test_damage_is_noticed():
    raw, _ = write([(1, list(range(50)))])
    for at in (5, len(raw) - 30):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(Exception):
            list(seekable.Reader(io.BytesIO(bytes(bad)), len(bad)).read())


def test_empty_file():
    raw, _ = write([])
    assert list(seekable.Reader(io.BytesIO(raw), len(raw)).read()) == []
    raw, _ = write([(4, [7, 8]), (6, [9])])
    r = seekable.Reader(io.BytesIO(raw), len(raw))
    assert list(r.read([])) == [] and list(r.read(r.find(5))) == [] and [k for _, k, _ in r.read(r.find(6))] == [6]


SCHEMA = "doc_id bigint, text string, part int, place string"


def test_files_over_a_table(spark, tmp_path):
    rows = [(5, "b c", 1, "x"), (None, "null id", 1, "x"), (3, None, 2, "y"), (3, "twice", 2, "y"), (9, "w " * 70_000, 3, "z"), (5, "b c", 1, "x")]
    folder = f"file://{tmp_path}/out"
    seekable.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, partitions=3)
    out = seekable.read_tokens(spark, folder).orderBy("start").collect()
    want = [ids_of(t or "") + [2] for _, t in sorted([(k if k is not None else -1, t or "") for k, t, _, _ in rows])]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in out] == want
    assert [r["start"] for r in out] == [sum(map(len, want[:i])) for i in range(len(want))]
    some = seekable.read_tokens(spark, folder, spark.createDataFrame([(r["file"], r["place"]) for r in out if r["doc_id"] == 3], "file string, place bigint"))
    assert sorted(r["n_tokens"] for r in some.collect()) == sorted(len(w) for w in want[1:3])
    assert not [p for p in tmp_path.glob("out/*.zst.*")]  # no unfinished file is left


def test_files_are_read_by_as_many_tasks(spark, tmp_path):
    folder = f"file://{tmp_path}/many"
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    seekable.write_tokens(rows, folder, partitions=6)
    read = seekable.read_tokens(spark, folder)
    assert read.select(F.spark_partition_id()).distinct().count() == 6 and read.count() == 600


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    seekable.write_tokens(spark.createDataFrame([], SCHEMA), folder)
    assert seekable.read_tokens(spark, folder).count() == 0


def test_file_query(spark, sf):
    out = queries.op2_token_files(spark, sf).orderBy("doc_id").collect()
    at = 0
    for r, d in zip(out, spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = np.array(ids_of(d["text"] or "") + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
