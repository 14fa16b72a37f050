import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlake.llm import packing, queries, tokens

DOCS = "doc_id bigint, text string, source string, length string, salt int"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.sampled_from(["dot", "norm"]), st.integers(1, 9), st.sampled_from([None, 600]))
def test_plan_places_every_piece_once_within_all_capacities(histogram, score, most, attention):
    if attention:
        histogram = {k: v for k, v in histogram.items() if k * k <= attention}
    plan = packing.best_fit_plan(histogram, packing.Capacity(40, most, attention), score)
    bins = defaultdict(list)
    for length, n in histogram.items():
        where, offset = plan.find(np.full(n, length), np.arange(n))
        for b, o in zip(where.tolist(), offset.tolist(), strict=True):
            bins[b].append((o, length))
    assert set(bins) == set(range(plan.n_sequences))
    for parts in bins.values():
        end = 0
        for o, length in sorted(parts):
            assert o == end
            end += length
        assert end <= 40 and len(parts) <= most
        assert attention is None or sum(x * x for _, x in parts) <= attention
    total = sum(k * v for k, v in histogram.items())
    assert plan.n_sequences >= -(-total // 40)


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.integers(1, 2049, 20_000), return_counts=True)
    plan = packing.best_fit_plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), packing.Capacity())
    assert plan.n_sequences <= 1.01 * -(-int((lengths * counts).sum()) // 2048) + 1


def test_short_pieces_reach_the_lower_bound():
    lengths, counts = np.unique(np.random.default_rng(6).integers(1, 4, 200_000), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    least = -(-int((lengths * counts).sum()) // 2048)
    assert packing.best_fit_plan(histogram, packing.Capacity()).n_sequences == least
    assert packing.best_fit_plan({2: 2000}, packing.Capacity()).n_sequences == 2
    few = packing.best_fit_plan(histogram, packing.Capacity(pieces=512))
    assert few.n_sequences == -(-200_000 // 512)


def test_attention_binds_where_it_is_bounded():
    # four of 512 tokens fill a sequence; two of them are all that this attention allows
    assert packing.best_fit_plan({512: 40}, packing.Capacity()).n_sequences == 10
    assert packing.best_fit_plan({512: 40}, packing.Capacity(attention=2 * 512**2)).n_sequences == 20
    # short pieces still fill the tokens that the attention of long ones leaves
    assert packing.best_fit_plan({512: 40, 16: 20 * 64}, packing.Capacity(attention=2 * 512**2 + 64 * 16**2)).n_sequences == 20


def test_a_piece_beyond_a_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit_plan({5: 1}, packing.Capacity(10, 5, attention=20))


def test_packs_odd_documents(spark):
    texts = [None, "", "a b c", "a b c", "word " * 5000, "x" * 9000, "Ünï <|endoftext|> 日本"]
    rows = [(i, t, "s", "clash", 7) for i, t in enumerate(texts)] + [(2, "a b c", "s", None, None), (None, "null id", None, None, None)]
    out = packing.pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    t = Tokenizer.from_file(tokens.default_path())
    ids = defaultdict(bytes)
    for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["piece"])):
        assert r["start"] == r["piece"] * 2048 and 1 <= r["length"] <= 2048 and len(r["ids"]) == 4 * r["length"]
        ids[r["doc_id"]] += r["ids"]
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(ids[i], "<u4").tolist() == want * (2 if i == 2 else 1)
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 2048


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_a_hot_length_is_ranked_over_many_groups(spark):
    n = 3 * packing.ROWS_PER_SALT
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(500).alias("length"))
    out = packing.pack(rows)
    assert out.groupBy("sequence_id").count().where("count > 4").count() == 0
    assert out.select("sequence_id", "offset").distinct().count() == n


def test_query(spark, sf):
    out = queries.op1_best_fit_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert set(out.doc_id) == set(docs.doc_id)
    t = Tokenizer.from_file(tokens.default_path())
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = out[out.doc_id == i].sort_values("piece")
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
    assert out.sequence_id.nunique() <= -(-int(out.length.sum()) // 2048) + 2
    # every sequence is gapless from 0 over the whole table, every document whole
    placed = out.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    cut = out.sort_values(["doc_id", "piece"])
    assert (cut.start == cut.groupby("doc_id").length.cumsum() - cut.length).all() and (cut.piece == cut.groupby("doc_id").cumcount()).all()
    assert (cut.length[cut.piece < cut.groupby("doc_id").piece.transform("max")] == 2048).all()
