"""Work payload files as they arrive.

A directory of JSON lines is read as a stream.  ``latest`` drops, by the stream's state,
what comes after a newer payload of its work and person; the rest of each micro-batch is
merged into the store, which writes the changes only.  The stream's checkpoint tells which
files are done and holds the state, and a merge by key gives the same tables if a batch
runs twice: together they end as one batch over all files would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.works import WORK
from ..plans.pipeline import Context, save_links, save_works
from ..scratch import cut
from .latest import last_words

PAYLOAD = f"professor_id bigint, author_id string, seq bigint, {WORK}"


def payload_stream(ctx: Context, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The lines of the files, in ``value``."""
    return ctx.spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)


def ingest(ctx: Context, folder: str, checkpoint: str, available_now: bool = True, ttl_days: float | None = None) -> StreamingQuery:
    """Upsert what is there (or, with ``available_now`` off, all that comes)."""

    def batch(rows: DataFrame, number: int) -> None:
        held = cut(rows.select(F.from_json("payload", PAYLOAD).alias("p"), "new_work", "new_link").select("p.*", "new_work", "new_link"))
        if not held.isEmpty():
            save_works(ctx, held.where("new_work").drop("new_work", "new_link"), links=False)
            save_links(ctx, held.where("new_link").drop("new_work", "new_link"))

    writer = last_words(payload_stream(ctx, folder), ttl_days).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
