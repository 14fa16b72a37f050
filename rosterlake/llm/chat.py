"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered into one string by a template that marks
turns with control strings; control strings inside roles and texts are escaped
reversibly.  The whole string is encoded once, with offsets.  The spans of the
turns that carry loss are sorted, as are the tokens' spans, so the mask is an
intersection by binary search.  Control strings are special tokens, so no token
reaches over the edge of a text.

Escaping: a backslash is doubled, and a backslash is put after the first
character of every control string.  ``unescape`` undoes both.

Defined cases: null text, role or tokens count as empty; turns are ordered by
turn (null first), then role, then text; rows that repeat are turns of their own;
rows without a conv_id form one conversation; an empty table gives no rows; extra
columns are left out.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

FORMATTED = "conv_id bigint, n_turns bigint, formatted string, ids binary, loss_mask binary, loss_spans array<struct<start:int,end:int>>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Template:
    """Control strings of the template itself, and further ones that texts must
    not hold either because models give them a meaning."""

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>"
    reserved: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.says, self.end, *self.reserved)

    @functools.cached_property
    def _escape(self) -> re.Pattern:
        return re.compile("|".join(re.escape(c) for c in self.controls))

    @functools.cached_property
    def _turns(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.turn)}(.*?){re.escape(self.says)}(.*?){re.escape(self.end)}", re.S)

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The string, and the span of each turn's text in it."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.turn}{self.escape(role)}{self.says}", self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.end]
            at = spans[-1][1] + len(self.end)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn, unescaped."""
        return [(self.unescape(m[1]), self.unescape(m[2])) for m in self._turns.finditer(formatted)]


@functools.cache
def tokenizer(path: str, template: Template):
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in template.controls])
    return found


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For tokens and disjoint spans, both in order: which tokens touch a span, and
    the stretches of the spans that tokens cover."""
    mask, covered = np.zeros(len(starts), np.uint8), []
    if not spans or not len(starts):
        return mask, covered
    span = np.array(spans, np.int64)
    first = np.searchsorted(ends, span[:, 0], side="right")  # first token that ends after the span's start
    last = np.searchsorted(starts, span[:, 1], side="left")  # first token that starts at or after its end
    for (lo, hi), a, b in zip(spans, first.tolist(), last.tolist(), strict=True):
        if a < b and lo < hi:
            mask[a:b] = 1
            covered.append((max(lo, int(starts[a])), min(hi, int(ends[b - 1]))))
    return mask, covered


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), template: Template | None = None, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, ids (little-endian u32), loss_mask (a byte a
    token) and loss_spans (code points of ``formatted`` under the mask)."""
    template, path = template or Template(), path or default_path()
    small_batches(rows.sparkSession)
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, template)
        for batch in batches:
            turns = batch.column(1)
            cuts = turns.offsets.to_pylist()
            flat = turns.flatten()
            roles, texts = flat.field("role").to_pylist(), flat.field("text").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for a, b in zip(cuts, cuts[1:], strict=False):
                formatted, spans = template.render(list(zip(roles[a:b], texts[a:b], strict=True)))
                found = encode.encode(formatted, add_special_tokens=False)
                at = np.array(found.offsets, np.int64).reshape(-1, 2)
                mask, covered = align(at[:, 0], at[:, 1], [s for s, r in zip(spans, roles[a:b], strict=True) if r in loss_roles])
                for column, value in zip(out, (b - a, formatted, np.array(found.ids, "<u4").tobytes(), mask.tobytes(), [{"start": s, "end": e} for s, e in covered]), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), span)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_spans"])

    return whole.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from its formatted output alone: the turns, and the text
    under the loss mask, unescaped."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses = [], []
            for line, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append([{"role": r, "text": t} for r, t in template.parse(line)])
                losses.append("".join(template.unescape(line[s["start"] : s["end"]]) for s in spans))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(losses, pa.string()), batch.column(1)], names=["conv_id", "turns", "loss_text", "formatted"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id bigint, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
