"""Hybrid scoring and ranking of each query's subgraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.traverse import keep_between
from citeloom.runtime import top_k_per_group
from citeloom.settings import DEFAULTS, RANK_LABELS, effective_k


def average_confidence(edges: DataFrame) -> DataFrame:
    """Mean confidence of the edges at each node; a self-loop counts once."""
    return (
        edges.select("query_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"), "conf")
        .groupBy("query_id", "node_id")
        .agg(F.avg("conf").alias("avg_confidence"))
    )


def best_chunk_score(chunk_seeds: DataFrame) -> DataFrame:
    """Best chunk score per (query, paper), never below 0."""
    return (
        chunk_seeds.filter(F.coalesce("paper_id", F.lit("")) != "")
        .groupBy("query_id", "paper_id")
        .agg(F.greatest(F.max("score"), F.lit(0.0)).alias("chunk_score"))
    )


def label_rank(label: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(x) for x in RANK_LABELS]), label)
    return F.when(F.coalesce(rank, F.lit(0)) == 0, F.lit(len(RANK_LABELS) + 1)).otherwise(rank)


def similarity(nodes: DataFrame, entity_seeds: DataFrame, chunk_seeds: DataFrame) -> DataFrame:
    """Adds ``similarity``: the node's own seed score, else its paper's best chunk, else 0."""
    own = entity_seeds.groupBy("query_id", "node_id").agg(F.max("score").alias("own_score"))
    return (
        nodes.join(own, ["query_id", "node_id"], "left")
        .join(best_chunk_score(chunk_seeds), ["query_id", "paper_id"], "left")
        .withColumn(
            "similarity",
            F.coalesce(
                "own_score", F.when(F.col("label") == "Paper", F.col("chunk_score")), F.lit(0.0)
            ),
        )
        .drop("own_score", "chunk_score")
    )


def hybrid_score(sim: Column, distance: Column, confidence: Column, alpha: float, beta: float, gamma: float) -> Column:
    near = F.when(distance.isNull(), F.lit(0.0)).otherwise(1 / F.greatest(distance, F.lit(1)).cast("double"))
    return alpha * sim + beta * near + gamma * F.coalesce(confidence, F.lit(0.0))


def score_nodes(
    nodes: DataFrame, edges: DataFrame, distances: DataFrame, entity_seeds: DataFrame,
    chunk_seeds: DataFrame, alpha: float | None = None, beta: float | None = None,
    gamma: float | None = None,
) -> DataFrame:
    """Adds similarity, distance, avg_confidence and score to the subgraph's nodes.

    nodes(query_id, node_id, node_ord, label, paper_id, ...). A weight of 0 is
    honoured; only None means the default.
    """
    weights = [d if w is None else w for w, d in
               zip((alpha, beta, gamma), (DEFAULTS.alpha, DEFAULTS.beta, DEFAULTS.gamma))]
    return (
        similarity(nodes, entity_seeds, chunk_seeds)
        .join(distances, ["query_id", "node_id"], "left")
        .join(average_confidence(edges), ["query_id", "node_id"], "left")
        .withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))
        .withColumn(
            "score",
            F.round(hybrid_score(F.col("similarity"), F.col("distance"), F.col("avg_confidence"), *weights), 9),
        )
    )


def rank_nodes(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """Best ``top_k`` nodes: score, then Method < Paper < Dataset < rest, then first seen."""
    order = [F.desc("score"), label_rank(F.col("label")), F.col("node_ord"), F.col("node_id")]
    return top_k_per_group(
        scored, ["query_id"], order, effective_k(top_k, DEFAULTS.ranked_nodes), "rank"
    )


def ranked_edges(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """Edges between two ranked nodes."""
    return keep_between(edges, ranked.select("query_id", "node_id"))
