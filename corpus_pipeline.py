"""The corpus pipeline: toxicity, exact and near duplicates, mixing, packing.

Every stage takes what its predecessor kept, written as Parquet and read again.  All but the last return the
columns of ``documents``.  A stage sees only its own input; labels are read from the tables' folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipsieve.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from clipsieve.llm.common import table, written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.kept_rows(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.kept_rows(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.copies(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", stage_toxicity), ("exact_dedup", stage_exact_dedup), ("near_dedup", stage_near_dedup), ("mixing", stage_mixing), ("packing", stage_packing),
]

#: Training, sketches and tokenisation have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name)
    return docs
