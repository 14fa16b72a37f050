"""Which arrivals of a stream are the last word on their key, across batches and restarts.

A work's payload may arrive late: after one of a greater ``seq``, in a later file.  The
stream's state keeps, for each work, the greatest ``seq`` seen, and for each of its people
the greatest seen with them; an arrival that is below both says nothing new and is dropped
before anything is written.  State lies in the stream's checkpoint, so a restart goes on
with it, and is as large as the keys: a number each, not the payloads.  With ``ttl_days`` a
work that long unseen is forgotten, and an older arrival after that counts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows in: key, who, seq, payload; and out: the payload, and what it is the last word on.
OUT = "payload string, new_work boolean, new_link boolean"
#: A person's number where an arrival names none.
NOBODY = -(1 << 62)


class LastWord(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.work = handle.getValueState("work", "seq bigint", self.ttl_ms)
        self.people = handle.getMapState("people", "who bigint", "seq bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.work.get()[0] if self.work.exists() else None
        best_work: tuple[int, str] | None = None
        links: dict[int, tuple[int, str]] = {}
        for part in rows:
            for who, seq, payload in zip(part["who"].tolist(), part["seq"].tolist(), part["payload"].tolist(), strict=True):
                if (last is None or seq > last) and (best_work is None or (seq, payload) > best_work):
                    best_work = (seq, payload)
                if who != NOBODY and (who not in links or (seq, payload) > links[who]):
                    links[who] = (seq, payload)
        out: dict[str, list[bool]] = {}
        if best_work is not None:
            self.work.update((best_work[0],))
            out.setdefault(best_work[1], [False, False])[0] = True
        for who, (seq, payload) in links.items():
            if not self.people.containsKey((who,)) or seq > self.people.getValue((who,))[0]:
                self.people.updateValue((who,), (seq,))
                out.setdefault(payload, [False, False])[1] = True
        if out:  # texts as objects: an Arrow-backed column may come in chunks
            yield pd.DataFrame({"payload": pd.Series(list(out), dtype=object), "new_work": [v[0] for v in out.values()], "new_link": [v[1] for v in out.values()]})

    def close(self) -> None:
        pass


def last_words(lines: DataFrame, ttl_days: float | None = None) -> DataFrame:
    """(payload, new_work, new_link) of the JSON lines in ``value`` that are the last word on
    their work, or on their work and person, so far."""
    spark: SparkSession = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = F.from_json("value", "id string, professor_id bigint, seq bigint")
    rows = lines.select(told.alias("t"), F.col("value").alias("payload")).where("t.id IS NOT NULL")
    rows = rows.select(F.col("t.id").alias("key"), F.coalesce("t.professor_id", F.lit(NOBODY)).alias("who"), F.coalesce("t.seq", F.lit(-1)).alias("seq"), "payload")
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)
    return rows.groupBy("key").transformWithStateInPandas(LastWord(ttl), OUT, "Update", "None" if ttl is None else "ProcessingTime")
