"""Many patterns in one pass over a text.

An Aho-Corasick automaton holds all patterns; a text is read once, whatever their number.
Patterns come as a table.  They go to the tasks in parts of at most ``PART_CHARS``
characters, which bounds a broadcast and an automaton; more patterns make more parts, each
a pass over the texts.  A worker builds the automaton of a part once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: Characters of the patterns that are broadcast at once; an automaton takes some 50 times
#: as many bytes.
PART_CHARS = 4_000_000
_built: dict[str, ahocorasick.Automaton | None] = {}


def automaton(patterns: list[str]) -> ahocorasick.Automaton | None:
    """None without a pattern; the empty pattern is in every text, and not held here."""
    out = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        if p:
            out.add_word(p, k)
    if not len(out):
        return None
    out.make_automaton()
    return out


def contained(found: ahocorasick.Automaton | None, text: str) -> list[int]:
    """Which patterns a text contains, once each, in order."""
    return sorted({k for _, k in found.iter(text)}) if found is not None else []


def parts(patterns: DataFrame) -> Iterator[list[str]]:
    """The different values of the one column of ``patterns``, some at a time."""
    held, weight = [], 0
    for (p,) in cut(patterns.where(F.col(patterns.columns[0]).isNotNull()).distinct()).toLocalIterator():
        if held and weight + len(p) > PART_CHARS:
            yield held
            held, weight = [], 0
        held.append(p)
        weight += len(p)
    if held:
        yield held


def pairs(rows: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(key, pattern): a row for each row and each different pattern that its text contains,
    letter for letter.  A null text contains none."""
    kind = rows.schema[key].dataType.simpleString()
    schema, out = f"`{key}` {kind}, pattern string", None
    for part in parts(patterns):
        shared, name = rows.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            own = shared.value
            if name not in _built:
                _built.clear()  # of another part, or an earlier search
                _built[name] = automaton(own)
            empty = [k for k, p in enumerate(own) if not p]
            for batch in batches:
                at, which = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if t is not None:
                        hits = contained(_built[name], t) + empty
                        at += [i] * len(hits)
                        which += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([own[k] for k in which], pa.string())], names=[key, "pattern"])

        found = rows.select(key, text).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)
