"""A training corpus from ``documents``: quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and
returns what it keeps; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlake.llm import common, dedup, packing, quality, simhash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: No stage but the second can be expressed in SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again, and removed
    once the next one's is written, as is what a stage has left on its way."""
    rows, before, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, common.waiting()
    for name, stage in STAGES:
        path = common.scratch(spark, name.replace(" ", "-"))
        stage(spark, rows, sf_dir).write.parquet(path)
        common.sweep(spark, others)
        rows = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return rows
