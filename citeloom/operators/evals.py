"""Evaluation arithmetic over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.replies import confidence
from citeloom.functions.text import norm_title


def clamp_score(value: Column) -> Column:
    """A judge's score clamped to [0, 1]; anything that is no number counts as 0."""
    return confidence(value)


def recall(questions: DataFrame, sources: DataFrame, cited: DataFrame) -> DataFrame:
    """Share of each question's source titles that were cited; 1.0 without sources.

    questions(question_id), sources(question_id, title), cited(question_id,
    title). Repeated sources count each.
    """
    seen = cited.select("question_id", norm_title(F.col("title")).alias("norm")).distinct().withColumn("hit", F.lit(1))
    per_source = sources.select("question_id", norm_title(F.col("title")).alias("norm")).join(seen, ["question_id", "norm"], "left")
    shares = per_source.groupBy("question_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return questions.select("question_id").join(shares, "question_id", "left").na.fill(1.0, ["recall"])


def summarise(results: DataFrame) -> DataFrame:
    """Accuracy and recall of both systems overall and per category, mean latency; rounded to 3.

    results(category, graph_score, graph_recall, plain_score, plain_recall,
    latency_ms). The overall row has a null category.
    """
    means = [F.bround(F.avg(c), 3).alias(c) for c in
             ("graph_score", "graph_recall", "plain_score", "plain_recall", "latency_ms")]
    return results.rollup("category").agg(F.count("*").alias("n"), *means)


def wins(results: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The first examples in which the graph system scored higher."""
    return results.filter(F.col("graph_score") > F.col("plain_score")).orderBy(order).limit(limit)


def report(summary: DataFrame) -> DataFrame:
    """Markdown table lines of a summary, overall first: (line_no, line)."""
    name = F.coalesce("category", F.lit("Overall"))
    cells = F.concat_ws(" | ", name, *[F.col(c).cast("string") for c in ("graph_score", "plain_score", "graph_recall", "plain_recall")])
    return summary.select(F.coalesce("category", F.lit("")).alias("line_no"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")).orderBy("line_no")
