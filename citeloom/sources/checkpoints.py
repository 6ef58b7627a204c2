"""Finished work units, so that a rerun does only what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def save(results: DataFrame, folder: str) -> None:
    """Append finished units (paper_id, section, kind, data), laid out by kind."""
    results.select("paper_id", "section", "kind", "data").write.mode("append").partitionBy("kind").parquet(folder)


def load(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Finished units of a kind, one per (paper, section); unreadable data counts as missing."""
    try:
        rows = spark.read.schema("paper_id string, section string, data string, kind string").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], "paper_id string, section string, data string, kind string")
    good = rows.filter((F.col("kind") == kind) & F.try_parse_json("data").isNotNull())
    return good.groupBy("paper_id", "section").agg(F.min("data").alias("data"))


def unfinished(units: DataFrame, done: DataFrame) -> DataFrame:
    return units.join(done.select("paper_id", "section"), ["paper_id", "section"], "left_anti")


def remaining_after_clear(done: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Units to keep once the papers in succeeded(paper_id) are complete."""
    return done.join(succeeded.select("paper_id"), "paper_id", "left_anti")
