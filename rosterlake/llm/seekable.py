"""Token ids in binary files that readers can seek in.

A file is a row of independent zstandard frames, then a seek table.  A frame
holds the ids (little-endian unsigned 32-bit) of whole documents, up to about
``FRAME_IDS``; a longer document fills a frame alone.  The seek table is a
zstandard skippable frame, so ordinary decoders pass over it:

    u32 0x184D2A5E, u32 size of what follows
    per frame:    u32 compressed bytes, u32 ids, u32 crc32 of the ids' bytes, u32 documents
    per document: i64 doc_id, u8 1 if the doc_id is null, u32 ids
    u32 crc32 of the entries, u32 frames, u32 documents, u8 version, u32 0x8F92EAB1

A reader takes the tail, then the table, then only the frames of the documents
asked for, and checks each frame against its checksum.

Writing: documents are range-partitioned by doc_id (ties by text) and a task
writes its range to one file, under a name of its own that is then renamed, so a
task that is lost or runs twice leaves the same file.  The manifest (one row a
file) is written last; without it the folder counts as incomplete.

Defined cases: null text is the empty text, which holds only the end id; a null
doc_id comes first; repeated rows are written as often as they occur; an empty
table gives a manifest without rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import small_batches

SKIPPABLE, SEEKABLE, VERSION = 0x184D2A5E, 0x8F92EAB1, 1
FRAME_IDS = 65_536
#: Tasks for each core that files are read by, where there are as many files.
READERS = 16
FRAME = np.dtype([("bytes", "<u4"), ("ids", "<u4"), ("crc", "<u4"), ("docs", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4")])
FOOTER = struct.Struct("<IIIBI")
MANIFEST = "file string, part int, first_doc bigint, n_docs bigint, n_ids bigint, n_frames bigint, n_bytes bigint"


class Writer:
    """Writes one file; ``put`` documents in order, then ``close``."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3):
        self.sink, self.frame_ids, self.zstd = sink, frame_ids, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.n_held = self.n_ids = self.n_bytes = 0

    def put(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.held and self.n_held + n > self.frame_ids:
            self._frame()
        self.held.append(ids)
        self.n_held += n
        self.docs.append((doc_id or 0, doc_id is None, n))

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), self.n_held, zlib.crc32(raw), len(self.held)))
        self.n_ids, self.n_bytes = self.n_ids + self.n_held, self.n_bytes + len(packed)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        entries = np.array(self.frames, FRAME).tobytes() + np.array(self.docs, DOC).tobytes()
        footer = FOOTER.pack(zlib.crc32(entries), len(self.frames), len(self.docs), VERSION, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        self.sink.write(table)
        self.n_bytes += len(table)


class Reader:
    """Reads single documents of a file opened for random access."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        crc, n_frames, n_docs, version, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE or version != VERSION:
            raise ValueError("not a token file")
        length = n_frames * FRAME.itemsize + n_docs * DOC.itemsize
        source.seek(size - FOOTER.size - length)
        entries = source.read(length)
        if zlib.crc32(entries) != crc:
            raise ValueError("the seek table does not match its checksum")
        self.frames = np.frombuffer(entries, FRAME, n_frames)
        self.docs = np.frombuffer(entries, DOC, n_docs, n_frames * FRAME.itemsize)
        self.at = np.concatenate([[0], np.cumsum(self.frames["bytes"], dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.frames["docs"], dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        raw = self.zstd.decompress(self.source.read(int(self.frames[k]["bytes"])), max_output_size=4 * int(self.frames[k]["ids"]) or 1)
        if zlib.crc32(raw) != self.frames[k]["crc"]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        """(place in the file, doc_id, ids) of the documents at the given places,
        or of all; frames without a wanted document stay compressed."""
        places = np.arange(len(self.docs)) if wanted is None else np.unique(np.fromiter(wanted, np.int64))
        if not len(places):
            return
        frame_of = np.searchsorted(self.first, places, side="right") - 1
        frames, begin = np.unique(frame_of, return_index=True)
        for k, a, b in zip(frames.tolist(), begin.tolist(), [*begin[1:].tolist(), len(places)], strict=True):
            raw, lo = self.frame(k), int(self.first[k])
            ends = np.cumsum(self.docs["ids"][lo : int(self.first[k + 1])], dtype=np.int64) * 4
            for place in places[a:b].tolist():
                end, n = int(ends[place - lo]), 4 * int(self.docs[place]["ids"])
                yield place, None if self.docs[place]["null"] else int(self.docs[place]["doc_id"]), raw[end - n : end]

    def find(self, doc_id: int) -> list[int]:
        """Places of a document, by binary search: documents ascend after those of null
        doc_id."""
        lo = int(np.searchsorted(1 - self.docs["null"], 1))
        a, b = np.searchsorted(self.docs["doc_id"][lo:], [doc_id, doc_id + 1])
        return list(range(lo + int(a), lo + int(b)))


def open_file(uri: str) -> tuple[object, int]:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path), store.get_file_info(path).size


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` into files below ``folder`` (a URI all executors reach) and
    return the manifest, one row a file."""
    spark, path = docs.sparkSession, tokenizer or tokens.default_path()
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder, end, writer, sink = tokens.encoder(path), np.array([end_id], dtype="<u4").tobytes(), None, None
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part, first = batch.column(2)[0].as_py(), batch.column(0)[0].as_py()
                store.create_dir(base, recursive=True)
                final = f"{base}/tokens-{part:06d}.zst"
                own = f"{final}.{uuid.uuid4().hex}"
                sink = store.open_output_stream(own)
                writer = Writer(sink)
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                writer.put(key, ids + end)
        if writer is None:
            return
        writer.close()
        sink.close()
        try:
            store.move(own, final)
        except OSError:  # where a move does not replace: an earlier run of this task has left the same file
            if store.get_file_info(final).type != fs.FileType.File:
                raise
            store.delete_file(own)
        row = (f"{folder.rstrip('/')}/tokens-{part:06d}.zst", part, first, len(writer.docs), writer.n_ids, len(writer.frames), writer.n_bytes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
            names=["file", "part", "first_doc", "n_docs", "n_ids", "n_frames", "n_bytes"],
        )

    rows.mapInArrow(run, MANIFEST).write.mode("error").parquet(f"{folder.rstrip('/')}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files in the order of their documents, with the ids and documents ahead of each."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    return files.withColumn("ids_ahead", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """Documents of the files: doc_id, file, part, place, n_tokens, start, ids.

    ``wanted`` (file, place) restricts reading to those documents' frames.  Files are
    dealt out evenly, up to ``READERS`` a core in all; a task reads one at a time and
    holds one frame."""
    files = read_manifest(spark, folder)
    tasks = max(1, min(files.count(), READERS * spark.sparkContext.defaultParallelism))
    todo = files.select("file", "part", "ids_ahead")
    todo = todo.join(wanted.groupBy("file").agg(F.collect_set("place").alias("places")), "file") if wanted is not None else todo.withColumn("places", F.lit(None).cast("array<bigint>"))
    todo = todo.repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source, size = open_file(row["file"])
                reader = Reader(source, size)
                starts = np.concatenate([[0], np.cumsum(reader.docs["ids"], dtype=np.int64)]) + int(row["ids_ahead"])
                held: list[tuple] = []
                weight = 0
                for place, key, ids in reader.read(row["places"]):
                    held.append((key, row["file"], row["part"], place, len(ids) // 4, int(starts[place]), ids))
                    weight += len(ids)
                    if weight > 4 << 20:
                        yield _rows(held)
                        held, weight = [], 0
                source.close()
                if held:
                    yield _rows(held)

    return todo.mapInArrow(run, "doc_id bigint, file string, part int, place bigint, n_tokens bigint, start bigint, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["doc_id", "file", "part", "place", "n_tokens", "start", "ids"])
