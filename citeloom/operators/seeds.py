"""From query vectors to traversal seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.knn import vector_search
from citeloom.settings import DEFAULTS, effective_k


def entity_seeds(entity_vectors: DataFrame, queries: DataFrame, k: int | None, dimension: int) -> DataFrame:
    """k nearest entities per query, in every collection: (query_id, node_id, score, rank).

    entity_vectors(node_id, vector); queries(query_id, vector, ...).
    """
    corpus = entity_vectors.select(F.col("node_id").alias("id"), "vector")
    found = vector_search(
        corpus, queries.select("query_id", "vector"), effective_k(k, DEFAULTS.entity_top_k), dimension
    )
    return found.withColumnRenamed("id", "node_id")


def chunk_seeds(chunk_vectors: DataFrame, queries: DataFrame, k: int | None, dimension: int) -> DataFrame:
    """k nearest chunks per query inside its collection, if it names one.

    chunk_vectors(chunk_id, vector, paper_id, collection_id);
    queries(query_id, vector, collection_id).
    """
    corpus = chunk_vectors.select(
        F.col("chunk_id").alias("id"), "vector", F.col("collection_id").alias("scope")
    )
    asked = queries.select("query_id", "vector", F.col("collection_id").alias("scope"))
    found = vector_search(corpus, asked, effective_k(k, DEFAULTS.chunk_top_k), dimension)
    return found.withColumnRenamed("id", "chunk_id").join(
        chunk_vectors.drop("vector", "collection_id"), "chunk_id"
    )


def seed_papers(entities: DataFrame, chunks: DataFrame, entity_papers: DataFrame) -> DataFrame:
    """Distinct (query_id, paper_id) touched by a seed of either kind.

    entity_papers(node_id, paper_id) has one row per pair, so an entity that
    most papers use never becomes one wide array.
    """
    of_entities = entities.select("query_id", "node_id").join(entity_papers, "node_id").select("query_id", "paper_id")
    of_chunks = chunks.select("query_id", "paper_id")
    return (
        of_chunks.unionByName(of_entities).filter(F.coalesce("paper_id", F.lit("")) != "").distinct()
    )


def resolve_seeds(entities: DataFrame, papers: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Seed nodes (query_id, node_id): entities as they are, papers by id and collection."""
    paper_nodes = nodes.filter(F.col("label") == "Paper").select("paper_id", "node_id", "collection_id")
    scoped = (
        papers.join(queries.select("query_id", F.col("collection_id").alias("wanted")), "query_id")
        .join(paper_nodes, "paper_id")
        .filter(F.col("wanted").isNull() | (F.col("collection_id") == F.col("wanted")))
        .select("query_id", "node_id")
    )
    return entities.select("query_id", "node_id").unionByName(scoped).distinct()
