"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Part of the subpackage newsdigest.llm, whose operators it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsdigest.llm import decontaminate, mixing, near_dup, quality, sharding
from newsdigest.llm.common import cut, table
from newsdigest.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 10)."""
    ship_package(spark)
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (operator 1)."""
    ship_package(spark)
    return near_dup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 8)."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources meet their target weights (operator 9)."""
    return mixing.take(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix gets a shard and a place in it (operator 4)."""
    return sharding.shard(docs)


STAGES = [("quality classifier", quality_stage), ("MinHash near-dedup", near_dup_stage),
          ("benchmark decontamination", decontamination_stage), ("mixing to target weights", mixing_stage),
          ("sharding", sharding_stage)]

#: A trained classifier and hashed sketches have no SQL; tests/llm checks run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
