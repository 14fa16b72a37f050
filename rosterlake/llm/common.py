"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, shared_dir  # noqa: F401  ``cut`` is for the operators

#: Rows of an Arrow batch handed to Python.  Texts can reach hundreds of KB, so
#: a batch is kept to a few MB of usual text and tens of MB of the longest.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the memory that one Arrow batch of texts can take."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/rosterlake-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder and read again, and where."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Tables that results are still read from, in the order in which they were made.
_waiting: list[str] = []


class Scope:
    """Tables written on the way to a result; ``close`` removes them, once what was
    made of them is written.  Those of a ``later`` scope are read when the result is: who
    has written that removes them by ``sweep``."""

    def __init__(self, spark: SparkSession, later: bool = False):
        self.spark, self.paths, self.later = spark, [], later

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = table(df, name)
        (_waiting if self.later else self.paths).append(path)
        return out

    def close(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def waiting() -> int:
    """How many tables wait to be removed: what ``sweep`` is told not to touch."""
    return len(_waiting)


def sweep(spark: SparkSession, before: int = 0) -> None:
    """Remove the tables that results made since ``before`` are read from; these have to
    be written."""
    for path in _waiting[before:]:
        remove(spark, path)
    del _waiting[before:]


#: Rows of keys, some 100 bytes each, that may be broadcast.
BROADCAST_ROWS = 100_000


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it is counted to be small enough."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


#: A key is hot if more than one in so many rows has it, so fewer keys than this are hot,
#: and if it has more rows than a task could mind.
HOT, HOT_ROWS = 4096, 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> list:
    """The hot keys of a table (key, n): fewer than HOT, so they may go to the driver."""
    return [r[0] for r in counts.where((F.col("n") * HOT > total) & (F.col("n") > HOT_ROWS)).select(key).collect()]


def looked_up(rows: DataFrame, values: DataFrame, key: str, hot: list) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row a key, null where it
    has none.  Values of the ``hot`` keys are broadcast, so no task receives all rows of
    a hot key; the rest is shuffled."""
    if not hot:
        return rows.join(values, key, "left")
    is_hot = F.col(key).isin(hot)
    own = rows.where(is_hot).join(F.broadcast(values.where(is_hot)), key, "left")
    return own.unionByName(rows.where(~is_hot).join(values, key, "left"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
