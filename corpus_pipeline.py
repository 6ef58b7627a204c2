"""From raw documents to training shards: language, near copies, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import citeloom
from citeloom.llm import langid, mixing, neardup, sharding, tiling
from citeloom.runtime import written

# Helpers travel to the Python workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(citeloom)

SHARDS = 40
# What each domain should keep of its tokens: None is all, toxic text gets none.
TARGETS = {"good": None, "low": None, "toxic": 0.0}
# Language models, MinHash candidates and the fitted rates are not expressible in SQL.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected."""
    return langid.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every group of near copies."""
    return neardup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return tiling.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose fitted rate rounds to none."""
    return mixing.keep_mixed(docs, _table(spark, sf_dir, "labels"), TARGETS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document that is left."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language", identified),
    ("near duplicates", distinct),
    ("decontamination", decontaminated),
    ("mixture", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the whole table that the one before has written."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
