"""Both answer systems side by side, and the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.schema import VERDICTS


def compare(questions: DataFrame, graph: DataFrame, plain: DataFrame) -> DataFrame:
    """One row per question with both answers; the latency is the slower one's.

    questions(query_id, question); graph, plain(query_id, answer, latency_ms).
    """
    a = graph.select("query_id", F.col("answer").alias("graphrag_answer"), F.col("latency_ms").alias("_a"))
    b = plain.select("query_id", F.col("answer").alias("vanilla_answer"), F.col("latency_ms").alias("_b"))
    return questions.join(a, "query_id").join(b, "query_id").withColumn("latency_ms", F.greatest("_a", "_b")).drop("_a", "_b")


def log_rows(compared: DataFrame, created_at: Column) -> DataFrame:
    """Rows to append to the query log."""
    return compared.select(
        F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), "question"), 256).alias("query_log_id"),
        F.col("question").alias("query_text"), "graphrag_answer", "vanilla_answer", "latency_ms",
        F.lit(None).cast("string").alias("compare_verdict"), created_at.alias("created_at"),
    )


def vote(log: DataFrame, votes: DataFrame) -> DataFrame:
    """The latest valid vote overwrites the verdict: votes(query_log_id, verdict, seq)."""
    last = votes.filter(F.col("verdict").isin(*VERDICTS)).groupBy("query_log_id").agg(F.max_by("verdict", "seq").alias("_verdict"))
    return log.join(last, "query_log_id", "left").withColumn(
        "compare_verdict", F.coalesce("_verdict", "compare_verdict")).drop("_verdict")
