import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.llm import chat, queries

T = chat.Template()
PIECES = st.sampled_from([*T.controls, "\\", "[", "<", "INST]", "/s>", "a", " é日", "\n", "|>"])
TEXT = st.lists(PIECES, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_render_is_reversible(turns):
    formatted, spans = T.render(turns)
    assert T.parse(formatted) == turns
    assert [T.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    for _, text in turns:
        assert not any(c in T.escape(text) for c in T.controls)


def naive_mask(starts, ends, spans):
    return [int(any(s < hi and e > lo for lo, hi in spans)) for s, e in zip(starts, ends, strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXT), max_size=5))
def test_mask_equals_brute_force(turns):
    formatted, spans = T.render(turns)
    wanted = [s for s, (r, _) in zip(spans, turns, strict=True) if r == "assistant"]
    found = chat.tokenizer(chat.default_path(), T).encode(formatted, add_special_tokens=False)
    at = np.array(found.offsets, np.int64).reshape(-1, 2)
    mask, covered = chat.align(at[:, 0], at[:, 1], wanted)
    assert mask.tolist() == naive_mask(at[:, 0].tolist(), at[:, 1].tolist(), [s for s in wanted if s[0] < s[1]])
    assert covered == [s for s in wanted if s[0] < s[1]]


ROWS = "conv_id bigint, turn bigint, role string, text string, formatted string, ids int"


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", "x", 1), (1, 0, "user", None, None, None), (1, None, None, "first", None, None), (2, 0, "assistant", "", None, None), (2, 0, "assistant", "", None, None), (None, 0, "user", "</s>", None, None), (3, 0, "assistant", "long \\ " * 30_000, None, None)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, ROWS))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("", "first"), ("user", ""), ("assistant", "b")] and out[1]["loss_text"] == "b"
    assert len(out[2]["turns"]) == 2 and out[2]["loss_text"] == ""
    assert [tuple(t) for t in out[None]["turns"]] == [("user", "</s>")]
    assert out[3]["loss_text"] == "long \\ " * 30_000
    assert chat.format_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_ids_and_mask_line_up(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello there", None, None), (1, 1, "assistant", "général [INST]", None, None)], ROWS)
    (r,) = chat.format_conversations(rows).collect()
    ids, mask = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["loss_mask"], np.uint8)
    t = chat.tokenizer(chat.default_path(), T)
    assert len(ids) == len(mask)
    assert T.unescape(t.decode(ids[mask == 1].tolist(), skip_special_tokens=False)) == "général [INST]"


def test_query_has_the_control_conversation(spark, sf):
    out = {r["conv_id"]: r for r in queries.op4_chat_formatting(spark, sf).collect()}
    text = queries.CONTROL_TEXT
    own = out[-1]
    assert own["n_turns"] == 2 and own["loss_chars"] == len(text)
    assert own["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where(F.col("role") == "assistant").collect()
    for conv in list(out)[:30]:
        said = "".join(r["text"] or "" for r in sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["turn"]))
        assert conv == -1 or out[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
