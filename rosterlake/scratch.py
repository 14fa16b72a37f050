"""The folder that all executors share, and tables cut off from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and all tasks run on this machine (tests, local
    mode) a temporary folder becomes the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rosterlake-"))
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jvm_dir.get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/rosterlake-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as compressed files in the shared folder, for tables that are large and read by
    some of their columns; ``cut`` keeps rows as they are in memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
