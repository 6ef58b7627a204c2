"""The two retrieval paths for a batch of questions: graph and vector-only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import context as ctx
from citeloom.operators.ranking import rank_nodes, ranked_edges, score_nodes
from citeloom.operators.seeds import chunk_seeds, entity_seeds, resolve_seeds, seed_papers
from citeloom.operators.traverse import (
    cap_nodes, filter_entity_types, keep_between, scope_to_collection, seed_distances, traverse,
)
from citeloom.runtime import written
from citeloom.settings import DEFAULTS


@dataclass(frozen=True)
class Corpus:
    """The stored tables a question is answered from."""

    nodes: DataFrame            # schema.NODES
    edges: DataFrame            # schema.EDGES
    entity_vectors: DataFrame   # node_id, vector
    entity_papers: DataFrame    # node_id, paper_id
    chunk_vectors: DataFrame    # chunk_id, vector, paper_id, collection_id, section_name, text, page_number
    papers: DataFrame           # paper_id, title, ...
    dimension: int
    links: DataFrame | None = None  # the edges as traverse.store_two_way keeps them


@dataclass(frozen=True)
class Retrieved:
    entity_seeds: DataFrame
    chunk_seeds: DataFrame
    seeds: DataFrame
    edges: DataFrame      # subgraph, capped on request
    nodes: DataFrame
    scored: DataFrame
    ranked: DataFrame
    ranked_edges: DataFrame


def retrieve(
    corpus: Corpus, queries: DataFrame, hops: int | None = None, top_k: int | None = None,
    rel_types: list[str] | None = None, entity_types: list[str] | None = None,
    max_nodes: int | None = None, row_limit: int | None = None,
    entity_top_k: int | None = None, chunk_top_k: int | None = None,
    alpha: float | None = None, beta: float | None = None, gamma: float | None = None,
) -> Retrieved:
    """Seeds, traversal, scoping, cap, score and rank for queries(query_id, vector, collection_id).

    Rows and nodes are limited only if the request says so.
    """
    entities = written(entity_seeds(corpus.entity_vectors, queries, entity_top_k, corpus.dimension), "entity-seeds")
    chunks = written(chunk_seeds(corpus.chunk_vectors, queries, chunk_top_k, corpus.dimension), "chunk-seeds")
    papers = seed_papers(entities, chunks, corpus.entity_papers)
    seeds = written(resolve_seeds(entities, papers, corpus.nodes, queries), "seeds")
    edges, nodes = subgraphs(corpus, queries, seeds, hops, rel_types, entity_types, max_nodes, row_limit)
    described = nodes.join(corpus.nodes, "node_id")
    scored = written(
        score_nodes(described, edges, seed_distances(edges, seeds, row_limit is not None), entities, chunks, alpha, beta, gamma), "scored"
    )
    ranked = rank_nodes(scored, top_k)
    return Retrieved(entities, chunks, seeds, edges, nodes, scored, ranked, ranked_edges(edges, ranked))


def subgraphs(
    corpus: Corpus, queries: DataFrame, seeds: DataFrame, hops: int | None = None,
    rel_types: list[str] | None = None, entity_types: list[str] | None = None,
    max_nodes: int | None = None, row_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) around the seeds: traverse, filter labels, scope to the collection, then cap."""
    edges = traverse(corpus.edges, seeds, hops, rel_types, row_limit, links=corpus.links)
    if entity_types is not None:
        edges = written(filter_entity_types(edges, corpus.nodes, seeds, entity_types), "typed")
    edges, nodes = scope_to_collection(edges, corpus.nodes, queries)
    nodes = written(nodes, "scoped-nodes")
    nodes = written(cap_nodes(edges, nodes, max_nodes), "capped-nodes")
    return written(keep_between(edges, nodes.select("query_id", "node_id")), "capped-edges"), nodes


def with_properties(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Ranked edges with the properties the context shows."""
    return edges.join(
        stored.select("src", "dst", "rel_type", "evidence_text", "metric", "value", "dataset", "margin"),
        ["src", "dst", "rel_type"],
    )


def graph_context(corpus: Corpus, queries: DataFrame, found: Retrieved, max_tokens: int = DEFAULTS.context_tokens,
                  reserve: int = DEFAULTS.chunk_reserve_tokens, count=ctx.token_count) -> DataFrame:
    edges = with_properties(found.ranked_edges, corpus.edges)
    return ctx.build_context(
        queries, ctx.entity_lines(found.ranked, edges), ctx.relationship_lines(found.ranked, edges),
        ctx.chunk_lines(found.chunk_seeds), max_tokens, reserve, count,
    )


def retrieval_stats(queries: DataFrame, found: Retrieved, context: DataFrame) -> DataFrame:
    """Seed, node and token counts per query, 0 where nothing was found."""
    result = queries.select("query_id")
    for name, part in (("entity_seeds", found.entity_seeds), ("chunk_seeds", found.chunk_seeds),
                       ("graph_nodes", found.nodes), ("ranked_nodes", found.ranked)):
        result = result.join(part.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left")
    return result.na.fill(0).join(
        context.select("query_id", F.col("token_count").alias("context_tokens"),
                       F.col("truncated").alias("context_truncated")), "query_id", "left",
    )


def baseline(corpus: Corpus, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """Vector-only sources with paper titles: (query_id, rank, paper_id, ..., score)."""
    found = chunk_seeds(corpus.chunk_vectors, queries, top_k, corpus.dimension)
    return found.join(corpus.papers.select("paper_id", F.col("title").alias("paper_title")), "paper_id", "left")
