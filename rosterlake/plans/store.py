"""Tables that change: upserts as joins, and stores of versioned tables."""

from __future__ import annotations

import functools
import json
import operator
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import cut


def latest(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row a key, the one of greatest ``seq``; without that column."""
    rest = [c for c in rows.columns if c not in (*key, seq)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of, or beside, those of equal key;
    columns in ``keep`` stay as they were where the row was there before."""
    if not keep:
        return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))
    there = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in keep], F.lit(True).alias("was_there"))
    changed = new.join(there, key, "left")
    for c in keep:
        changed = changed.withColumn(c, F.when(F.col("was_there"), F.col(f"old_{c}")).otherwise(F.col(c)))
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(changed.select(old.columns))


def delete(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti").select(old.columns)


def target_ids(new: DataFrame, old: DataFrame, ident: str, first: list[str], then: list[str]) -> DataFrame:
    """``new`` with the id of the old row that each entry updates: by one key, else by
    another, null for a new row.  A null in a key matches nothing."""
    a = old.groupBy(first).agg(F.min(ident).alias("by_first"))
    b = old.groupBy(then).agg(F.min(ident).alias("by_then"))
    return new.join(a, first, "left").join(b, then, "left").withColumn(ident, F.coalesce("by_first", "by_then")).drop("by_first", "by_then")


def with_ids(new: DataFrame, old: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """``new`` with ids that follow the greatest of ``old``, in a stable order, so a
    repeated run gives the same ones.  Ranges are numbered apart and then added up:
    no task sorts the whole table."""
    (top,) = old.agg(F.coalesce(F.max(ident), F.lit(0))).first()
    held = cut(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("part").count().withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return held.withColumn("place", place).join(F.broadcast(sizes), "part").withColumn(ident, (F.col("place") + F.col("ahead") + int(top)).cast("bigint")).drop("part", "place", "ahead")


def add_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns that an older table lacks, as null."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in rows.columns})


def same(key: Iterable[str], prefix: str) -> Column:
    """Whether columns equal those of the same name behind ``prefix``."""
    return functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in key])


def _bucket(key: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class Conflict(FileExistsError):
    """Another writer has committed a version since this one read the table."""


@dataclass(frozen=True)
class Part:
    """A folder of rows: the base, in ``buckets`` by the hash of its key (0: not dealt out),
    or a delta, whose rows replace those of equal key before it."""

    folder: str
    rows: int
    buckets: int = 0


@dataclass(frozen=True)
class Version:
    number: int
    base: Part
    deltas: tuple[Part, ...] = ()
    key: tuple[str, ...] = ()


#: Deltas over a base, and their rows over the base's, before a merge makes a new base.
DELTAS, SHARE = 12, 0.25
#: Rows of a base's bucket, about.
BUCKET_ROWS = 1_000_000
#: Keys that a lookup tells to the scan, to skip buckets and row groups.
LOOKUP_KEYS = 1000
GONE, SEQ, BUCKET = "_gone", "_seq", "_bucket"


class Store:
    """Named tables below a folder, of versions that do not change.

    ``write`` makes a whole new base.  ``merge`` adds a delta: the changed rows and the
    keys of rows that go, so a change costs what it changes; a read puts the deltas' last
    row of each key in place of the base's.  When deltas grow, a merge makes a new base,
    dealt out by key and sorted, with Parquet's least and greatest values and Bloom filters
    of the key, by which ``get`` skips files and row groups.

    A version is a small file whose name is its number.  It is made whole and then put
    under that name only if no other has it, so one of two writers wins and the other
    knows.  ``merge`` goes on with the winner's version, ``update`` runs its change again
    on it; ``write`` raises ``Conflict`` if the table has changed since this store first
    read it, after its own last change or ``begin``.
    Keys are compared with null as a value.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._seen: dict[str, int] = {}

    def begin(self) -> None:
        """Forget what has been read: a ``write`` is held against what is read from now on."""
        self._seen = {}

    # versions

    def versions(self, name: str) -> list[int]:
        where = self._path(f"{self.path}/{name}/versions")
        found = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n) for n in found if n.isdigit())

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def version(self, name: str, number: int | None = None) -> Version | None:
        """A table's version, the last one if no number is given; None if there is none."""
        while True:
            known = self.versions(name) if number is None else [number]
            if not known:
                return None
            try:
                body = json.loads(self._text(f"{self.path}/{name}/versions/{known[-1]:010d}"))
            except Exception:
                if number is None and self.versions(name) != known:
                    continue  # it has just expired
                raise
            return Version(known[-1], Part(**body["base"]), tuple(Part(**d) for d in body["deltas"]), tuple(body["key"]))

    def _text(self, where: str) -> str:
        stream = self._fs.open(self._path(where))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, name: str, v: Version) -> bool:
        """Whether ``v`` became the version of its number; not if that number is taken."""
        folder = f"{self.path}/{name}/versions"
        own, final = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{v.number:010d}"
        stream = self._fs.create(self._path(own), False)
        stream.write(bytearray(json.dumps({"base": asdict(v.base), "deltas": [asdict(d) for d in v.deltas], "key": v.key}).encode()))
        stream.close()
        try:
            self._named(own, final)
        except Exception as e:
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(self._path(own), False)
        self._seen[name] = v.number
        return True

    def _named(self, own: str, final: str) -> None:
        """Give a finished file its name, if no other has it."""
        if self._fs.getScheme() == "file":  # where a rename replaces what is there, but a link does not
            try:
                return os.link(self._path(own).toUri().getPath(), self._path(final).toUri().getPath())
            except FileExistsError:
                raise
            except OSError:  # a mount without links
                pass
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(own), self._path(final), self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _put(self, name: str, rows: DataFrame, buckets: int = 0, key: tuple[str, ...] = ()) -> Part:
        """Rows written below a folder of their own, and counted by that write."""
        folder, seen = uuid.uuid4().hex, Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        if buckets:
            writer = writer.withColumn(BUCKET, _bucket(key, buckets)).repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, *key)
        writer = writer.write.option("compression", "zstd")
        if buckets:
            for c in key:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
            writer = writer.partitionBy(BUCKET)
        writer.parquet(f"{self.path}/{name}/data/{folder}")
        n = int(seen.get["rows"])
        # without rows there would be no file that tells the columns
        return Part(folder, n, buckets) if n or not buckets else self._put(name, rows)

    def _rows(self, name: str, part: Part) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/data/{part.folder}")

    def _may_write(self) -> None:
        if self.read_only:
            raise PermissionError("the store was opened for reading")

    # rows

    def read(self, name: str, schema: str | None = None, number: int | None = None) -> DataFrame:
        """A table as its last version has it, or the one of that number."""
        v = self.version(name, number)
        if v is None:
            if schema is None:
                raise LookupError(f"the store has no table {name}")
            self._seen.setdefault(name, 0)
            return self.spark.createDataFrame([], schema)
        if number is None:
            self._seen.setdefault(name, v.number)
        return self._merged(name, v)

    def _last(self, name: str, v: Version) -> DataFrame:
        """The last row of each key in the deltas, with GONE."""
        rows = None
        for k, part in enumerate(v.deltas):
            own = self._rows(name, part).withColumn(SEQ, F.lit(k))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if len(v.deltas) == 1:
            return rows.drop(SEQ)
        rest = [F.col(c) for c in rows.columns if c not in (*v.key, SEQ)]
        return rows.groupBy(*v.key).agg(F.max_by(F.struct(*rest), SEQ).alias("r")).select(*v.key, "r.*")

    def _merged(self, name: str, v: Version, only: Column | None = None, buckets: list[int] | None = None) -> DataFrame:
        base = self._rows(name, v.base)
        if buckets is not None and v.base.buckets:
            base = base.where(F.col(BUCKET).isin(buckets))
        base = base.drop(BUCKET)
        base = base if only is None else base.where(only)
        if not v.deltas:
            return base
        last = self._last(name, v)
        last = last if only is None else last.where(only)
        stay = base.join(last.select(*[F.col(c).alias(f"new_{c}") for c in v.key]), same(v.key, "new_"), "left_anti")
        return stay.unionByName(last.where(~F.col(GONE)).drop(GONE), allowMissingColumns=True)

    def get(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a table with these keys (its key columns).  Of few keys the scan
        reads only the buckets and row groups that may have them."""
        v = self.version(name)
        if v is None:
            raise LookupError(f"the store has no table {name}")
        key = v.key or tuple(keys.columns)
        only = buckets = None
        few = keys.select(*key).distinct().limit(LOOKUP_KEYS + 1).collect()
        if len(few) <= LOOKUP_KEYS:
            if not few:
                return self._merged(name, v).limit(0)
            values = [r[0] for r in few]
            if len(key) == 1 and None not in values:
                only = F.col(key[0]).isin(values)
            if v.base.buckets:
                kinds = keys.select(*key).withColumns({c: F.col(c).cast(self._rows(name, v.base).schema[c].dataType) for c in key})
                buckets = sorted({r[0] for r in kinds.select(_bucket(key, v.base.buckets)).distinct().collect()})
        rows = self._merged(name, v, only, buckets)
        wanted = keys.select(*[F.col(c).alias(f"new_{c}") for c in key]).distinct()
        return rows.join(wanted, same(key, "new_"), "left_semi")

    def rows(self, name: str) -> int | None:
        """A table's number of rows if its version tells; None where deltas lie over it."""
        v = self.version(name)
        return v.base.rows if v is not None and not v.deltas else None

    # changes

    def write(self, name: str, rows: DataFrame, key: list[str] | None = None) -> int:
        """Replace a table; with a ``key``, dealt out by it.  Returns the rows written.
        If this store has read the table, it must be as it was read, else ``Conflict``."""
        self._may_write()
        before = self._seen.get(name)
        before = max(self.versions(name), default=0) if before is None else before
        key = tuple(key or ())
        old = self.version(name)
        buckets = max(1, -(-(old.base.rows if old else 0) // BUCKET_ROWS)) if key else 0
        part = self._put(name, rows, buckets, key)
        if not self._commit(name, Version(before + 1, part, (), key)):
            self._seen.pop(name, None)
            raise Conflict(f"another writer has changed {name}")
        return part.rows

    def update(self, name: str, change: Callable[[DataFrame], DataFrame], schema: str | None = None, key: list[str] | None = None) -> int:
        """Replace a table by what ``change`` makes of it; made again of the newer table
        if another writer has changed it meanwhile."""
        while True:
            self._seen.pop(name, None)
            try:
                return self.write(name, change(self.read(name, schema)), key)
            except Conflict:
                continue

    def merge(self, name: str, rows: DataFrame | None, key: list[str], keep: list[str] | None = None, gone: DataFrame | None = None) -> int:
        """Put ``rows``, one a key, in place of, or beside, those of equal key; columns in
        ``keep`` stay as they were where the row was there before.  Rows with the keys of
        ``gone`` go.  Returns the number of changed keys.

        Only the changes are written.  They do not depend on the table, unless ``keep``
        says so; then they are made again if another writer commits first."""
        self._may_write()
        delta, made_for = None, None
        while True:
            v = self.version(name)
            if v is None:
                if rows is None:
                    return 0
                part = self._put(name, rows)
                if self._commit(name, Version(1, part, (), tuple(key))):
                    return part.rows
                continue
            if v.deltas and tuple(key) != v.key:
                v = self._compacted(name, v, tuple(key))
                if v is None:
                    continue
            if delta is None or (keep and made_for != v.number):
                delta, made_for = self._put(name, self._changes(name, v, rows, key, keep, gone)), v.number
            if not delta.rows:
                return 0
            if self._commit(name, Version(v.number + 1, v.base, (*v.deltas, delta), tuple(key))):
                break
        deltas = (*v.deltas, delta)
        if len(deltas) > DELTAS or sum(d.rows for d in deltas) > SHARE * v.base.rows + BUCKET_ROWS // 100:
            self._compacted(name, self.version(name), tuple(key))
        return delta.rows

    def _changes(self, name: str, v: Version, rows: DataFrame | None, key: list[str], keep: list[str] | None, gone: DataFrame | None) -> DataFrame:
        out = None
        if rows is not None:
            if keep:
                old = self._merged(name, v).select(*[F.col(c).alias(f"new_{c}") for c in key], *[F.col(c).alias(f"old_{c}") for c in keep], F.lit(True).alias("was_there"))
                names, rows = rows.columns, rows.join(old, same(key, "new_"), "left")
                rows = rows.withColumns({c: F.when(F.col("was_there"), F.col(f"old_{c}")).otherwise(F.col(c)) for c in keep}).select(names)
            out = rows.withColumn(GONE, F.lit(False))
        if gone is not None:
            gone = gone.select(*key).distinct().withColumn(GONE, F.lit(True))
            out = gone if out is None else out.unionByName(gone, allowMissingColumns=True)
        return out

    def _compacted(self, name: str, v: Version, key: tuple[str, ...]) -> Version | None:
        """A version with the deltas of ``v`` in its base; None if another came first, which
        then has them still."""
        buckets = max(1, -(-(v.base.rows + sum(d.rows for d in v.deltas)) // BUCKET_ROWS))
        done = Version(v.number + 1, self._put(name, self._merged(name, v), buckets, key), (), key)
        return done if self._commit(name, done) else None

    def compact(self, name: str) -> None:
        """Make deltas part of the base now."""
        self._may_write()
        while (v := self.version(name)) is not None and v.deltas:
            self._compacted(name, v, v.key)

    def expire(self, name: str, keep: int = 3, older_than_s: float = 86_400) -> int:
        """Forget all but the last ``keep`` versions and delete folders that none of these
        has.  Folders younger than that stay, as a writer may be about to name them;
        returns the number of folders deleted."""
        self._may_write()
        every = self.versions(name)
        stay = [v for n in every[-keep:] if (v := self.version(name, n)) is not None]
        for n in every[:-keep]:
            self._fs.delete(self._path(f"{self.path}/{name}/versions/{n:010d}"), False)
        named = {p.folder for v in stay for p in (v.base, *v.deltas)}
        where, count = self._path(f"{self.path}/{name}/data"), 0
        for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
            if s.getPath().getName() not in named and s.getModificationTime() <= 1000 * (time.time() - older_than_s):
                count += bool(self._fs.delete(s.getPath(), True))
        return count

    def folders(self, where: str) -> list[str]:
        """Finished outputs below a folder, in order of name."""
        root = self._path(where)
        found = [s.getPath() for s in self._fs.listStatus(root) if s.isDirectory()] if self._fs.exists(root) else []
        return sorted(p.toString() for p in found if self._fs.exists(self._path(f"{p.toString()}/_SUCCESS")))

    def remove(self, where: str) -> None:
        self._may_write()
        self._fs.delete(self._path(where), True)

    # a small table of states, on the driver

    def get_state(self, stage: str) -> dict:
        where = self._path(f"{self.path}/state/{stage}.json")
        if not self._fs.exists(where):
            return {"stage_name": stage, "status": "not_started", "checkpoint": None, "total_items": None, "processed_items": None}
        return json.loads(self._text(where.toString()))

    def put_state(self, stage: str, **changes) -> dict:
        self._may_write()
        state = self.get_state(stage) | changes
        stream = self._fs.create(self._path(f"{self.path}/state/{stage}.json"), True)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        return state
