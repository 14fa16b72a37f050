"""Size-tiered shards with a versioned manifest.

A store is a folder of immutable Parquet shards and of manifests, one a version,
each naming all live shards.  ``append`` writes an arrival as small shards.
``compact`` sorts live shards into tiers by size (tier i holds sizes within a
factor of ``fanout``); of a tier of at least ``fanout`` shards below the target size
as many as make ``MERGE`` bytes are rewritten at once, as files of about the target size
(one file, if they hold less).  ``vacuum`` deletes what no kept version names.

A manifest is a list of schemas and of pages, files of up to ``PAGE`` shards each; a
version writes pages only for shards that are new or whose page has lost one, so what an
append writes does not grow with the store.  A version is committed by renaming a finished file to its number, which fails if
that number exists, so of two writers one retries on the other's version.  Data
written by a job that is lost is named by no version.  All data moves by
DataFrame jobs; a manifest holds one line a shard.

Defined cases: rows keep their values, order is not kept; nulls, texts of any
length and repeated rows are rows like any other; an empty arrival adds no shard;
arrivals may have different columns, which a read fills with null; a store
without shards reads as an empty table of the first arrival's columns.
"""

from __future__ import annotations

import itertools
import json
import math
import urllib.parse
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET, FANOUT = 128 << 20, 4
#: Bytes that one merge rewrites, and shards of a manifest's page.
MERGE, PAGE = 64 * TARGET, 10_000


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    schema: str
    page: str = ""  # where the manifest has it; none for a new shard


def _name(path: str) -> str:
    """A file by its last two folders and name; a write's names are its own."""
    return "/".join(urllib.parse.unquote(path).rsplit("/", 3)[1:])


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, max(2, fanout)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), spark._jsc.hadoopConfiguration())

    # -- versions

    def _list(self, folder: str) -> list[tuple[str, int]]:
        where = self._path(f"{self.path}/{folder}")
        if not self._fs.exists(where):
            return []
        return [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(where) if s.isFile()]

    def versions(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _ in self._list("manifest")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """Version, live shards and the first arrival's schema."""
        if version is None:
            found = self.versions()
            if not found:
                return 0, [], None
            version = found[-1]
        body = self._read(f"v{version:010d}.json")
        live = [Shard(path, size, rows, body["schemas"][kind], page) for page in body["pages"] for path, size, rows, kind in self._read(page)]
        return version, live, body["schema"]

    def _read(self, name: str):
        stream = self._fs.open(self._path(f"{self.path}/manifest/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, body) -> object:
        path = self._path(f"{self.path}/manifest/{name}")
        stream = self._fs.create(path, False)
        stream.write(bytearray(json.dumps(body).encode()))
        stream.close()
        return path

    def _commit(self, parent: int, new: list[Shard], schema: str | None, what: str, live: list[Shard] = (), gone: set[str] = frozenset()) -> int:
        """The version after ``parent``: its shards without those in ``gone``, and the new
        ones.  ``live``, the parent's shards, is needed only where some go."""
        version = parent + 1
        before = self._read(f"v{parent:010d}.json") if parent else {"schema": None, "schemas": [], "pages": [], "sizes": []}
        pages = dict(zip(before["pages"], before["sizes"], strict=True))
        torn = {s.page for s in live if s.path in gone}
        rest = [s for s in live if s.page in torn and s.path not in gone] + list(new)
        pages = {p: n for p, n in pages.items() if p not in torn}
        schema = before["schema"] or schema
        schemas = list(dict.fromkeys([*before["schemas"], *(s.schema for s in rest)]))
        kind = {k: i for i, k in enumerate(schemas)}
        for at in range(0, len(rest), PAGE):
            name = f"p{uuid.uuid4().hex}.json"
            self._put(name, [(s.path, s.bytes, s.rows, kind[s.schema]) for s in rest[at : at + PAGE]])
            pages[name] = len(rest[at : at + PAGE])
        own = self._put(f".{uuid.uuid4().hex}", {"version": version, "parent": parent, "what": what, "schema": schema, "schemas": schemas, "pages": list(pages), "sizes": list(pages.values())})
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(own, self._path(f"{self.path}/manifest/v{version:010d}.json"), none)
        except Exception as e:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(version) from e
            raise
        return version

    def _write(self, df: DataFrame, by: str | None = None) -> list[Shard]:
        """Rows written as shards; ``by`` names a column of whole numbers that deals them into
        folders, in that order, and is left out."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{folder}")
        kept = df.drop(by) if by else df
        parts = [f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()] if by else [folder]
        parts.sort(key=lambda p: int(p.rsplit("=", 1)[1]) if by else 0)
        files = [(p, n) for part in parts for p, n in self._list(part) if p.endswith(".parquet")]
        if not files:
            return []
        paths = F.col("_metadata.file_path")
        counted = self.spark.read.schema(kept.schema).parquet(*[f"{self.path}/{p}" for p in parts]).groupBy(paths.alias("file")).count().collect()  # a row a file
        rows = {_name(r["file"]): r["count"] for r in counted}
        return [Shard(p, n, rows[_name(p)], kept.schema.json()) for p, n in files if rows.get(_name(p))]

    # -- operations

    def append(self, df: DataFrame) -> int:
        """Add an arrival; a task of ``df`` writes one shard."""
        return self._added(self._write(df), df.schema.json())

    def append_each(self, df: DataFrame, arrival: Column) -> int:
        """Add many arrivals, told by a whole number each, in that order: one pass over
        ``df`` writes the shards of all, then each is a version."""
        name = "_arrival"
        while name in df.columns:
            name = "_" + name
        version, last = 0, self.versions()
        for _, shards in itertools.groupby(self._write(df.withColumn(name, arrival), name), key=lambda s: s.path.rsplit("/", 2)[1]):
            version = self._added(list(shards), df.schema.json())
        return version or (last[-1] if last else self._added([], df.schema.json()))

    def _added(self, new: list[Shard], schema: str) -> int:
        while True:
            version = max(self.versions(), default=0)
            try:
                return self._commit(version, new, schema, "append")
            except Conflict:
                continue

    def tiers(self, live: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: at least ``fanout`` similarly sized shards, all under half
        the target size."""
        by: dict[int, list[Shard]] = {}
        for s in live:
            if 2 * s.bytes < self.target:
                by.setdefault(int(math.log(max(s.bytes, 1), self.fanout)), []).append(s)
        return [g for _, g in sorted(by.items()) if len(g) >= self.fanout]

    def share(self, group: list[Shard]) -> list[Shard]:
        """The first shards of a tier that make ``MERGE`` bytes, ``fanout`` at least."""
        taken, weight = [], 0
        for s in group:
            if weight >= MERGE and len(taken) >= self.fanout:
                break
            taken.append(s)
            weight += s.bytes
        return taken

    def compact(self) -> int:
        """Merge until no tier is full; each merge is a version.  Returns the last."""
        while True:
            version, live, schema = self.shards()
            groups = self.tiers(live)
            if not groups:
                return version
            group = self.share(groups[0])
            files = max(1, round(sum(s.bytes for s in group) / self.target))
            merged = self._write(self._frame(group, schema).coalesce(files))
            gone = {s.path for s in group}
            while True:
                version, live, schema = self.shards()
                if not gone <= {s.path for s in live}:
                    break  # another writer merged one of them: these files stay unnamed
                try:
                    self._commit(version, merged, schema, "compact", live, gone)
                    break
                except Conflict:
                    continue

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the last ``keep`` versions and the files that none of these
        names; returns the number of files.  Not to be run beside a writer."""
        versions = self.versions()
        named = {s.path for v in versions[-keep:] for s in self.shards(v)[1]}
        root, count = self._path(f"{self.path}/data"), 0
        for folder in self._fs.listStatus(root) if self._fs.exists(root) else []:
            files = self._files(folder.getPath())
            stale = [p for p in files if p.toString() not in named and p.getName().endswith(".parquet")]
            count += len(stale)
            if not any(p.toString() in named for p in files):
                self._fs.delete(folder.getPath(), True)
            else:
                for p in stale:
                    self._fs.delete(p, False)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:010d}.json"), False)
        pages = {p for v in versions[-keep:] for p in self._read(f"v{v:010d}.json")["pages"]}
        for path, _ in self._list("manifest"):
            if path.rsplit("/", 1)[1].startswith("p") and path.rsplit("/", 1)[1] not in pages:
                self._fs.delete(self._path(path), False)
        return count

    def _files(self, folder) -> list:
        each, out = self._fs.listFiles(folder, True), []
        while each.hasNext():
            out.append(each.next().getPath())
        return out

    def _frame(self, shards: list[Shard], schema: str | None) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(schema)) if schema else StructType())
        out = None
        for kind in dict.fromkeys(s.schema for s in shards):
            part = self.spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(*[s.path for s in shards if s.schema == kind])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        _, live, schema = self.shards(version)
        return self._frame(live, schema)
