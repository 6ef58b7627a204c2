"""One function per request of the service surface, over batches.

Each takes stored tables and returns data frames; nothing is served.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.generation import Provider
from citeloom.functions.vectors import embed
from citeloom.operators import browse, compare, extract, merge
from citeloom.operators import context as ctx
from citeloom.operators.retrieve import Corpus, Retrieved, baseline, graph_context, retrieval_stats, retrieve, subgraphs
from citeloom.operators.search import in_collection, search, searchable
from citeloom.operators.search_index import search_stored
from citeloom.runtime import written
from citeloom.settings import DEFAULTS
from citeloom.sources.snapshots import Snapshots

GRAPH_TASK = "Answer from the given context only and name the papers used. Say plainly if the context is not enough."
PLAIN_TASK = "Answer from the numbered excerpts only and cite them as [n]. Say plainly if they are not enough."
NO_GRAPH_CONTEXT = "The papers at hand hold nothing on this question, so it stays unanswered."
NO_EXCERPTS = "None of the stored excerpts matches this question."


def with_vectors(questions: DataFrame, dimension: int, model=None) -> DataFrame:
    """questions(query_id, question[, collection_id]) with their vectors, embedded once for both paths."""
    if "collection_id" not in questions.columns:
        questions = questions.withColumn("collection_id", F.lit(None).cast("string"))
    return written(questions.withColumn("vector", embed(F.col("question"), dimension, model)), "questions")


def query(corpus: Corpus, questions: DataFrame, providers: Sequence[Provider], hops: int | None = None,
          top_k: int | None = None, pause: float = 2.0, max_nodes: int | None = None, row_limit: int | None = None) -> dict[str, DataFrame]:
    """Graph answers: answers (with warning), citations, nodes, edges, stats, keyed by query_id."""
    found: Retrieved = retrieve(corpus, questions, hops=hops, top_k=top_k, max_nodes=max_nodes, row_limit=row_limit)
    context = written(graph_context(corpus, questions, found), "context")
    told = questions.select("query_id", "question").join(context.select("query_id", "text"), "query_id")
    answered = written(extract.answer(told, providers, GRAPH_TASK, NO_GRAPH_CONTEXT, pause), "answers")
    return {
        "answers": extract.faithfulness_warning(answered, providers, pause).drop("text"),
        "citations": ctx.citations(found.ranked, found.chunk_seeds, corpus.papers),
        "nodes": found.ranked,
        "edges": found.ranked_edges,
        "stats": retrieval_stats(questions, found, context),
    }


def query_vanilla(corpus: Corpus, questions: DataFrame, providers: Sequence[Provider], top_k: int | None = None,
                  pause: float = 2.0) -> dict[str, DataFrame]:
    """Vector-only answers: answers (with context_tokens) and sources."""
    sources = written(baseline(corpus, questions, top_k), "sources")
    context = ctx.baseline_context(sources)
    told = questions.select("query_id", "question").join(context, "query_id", "left").withColumn(
        "text", F.coalesce("text", F.lit(""))).withColumn("context_tokens", F.coalesce("token_count", F.lit(0))).drop("token_count")
    return {"answers": extract.answer(told, providers, PLAIN_TASK, NO_EXCERPTS, pause).drop("text"), "sources": sources}


def query_compare(corpus: Corpus, questions: DataFrame, providers: Sequence[Provider], hops: int | None = None,
                  top_k: int | None = None, vanilla_top_k: int | None = None, pause: float = 2.0) -> DataFrame:
    """Rows for the query log with both answers."""
    timed = lambda df: df["answers"].select("query_id", "answer", F.lit(None).cast("int").alias("latency_ms"))
    both = compare.compare(
        questions.select("query_id", "question"), timed(query(corpus, questions, providers, hops, top_k, pause)),
        timed(query_vanilla(corpus, questions, providers, vanilla_top_k, pause)),
    )
    return compare.log_rows(both, F.current_timestamp())


def graph_overview(corpus: Corpus, collection: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(node counts, edge counts) with totals, of the whole graph or of a collection's whole subgraph."""
    if collection is None:
        return browse.node_counts(corpus.nodes), browse.edge_counts(corpus.edges)
    edges, nodes = _collection(corpus, collection, None)
    labelled = nodes.join(corpus.nodes.select("node_id", "label"), "node_id")
    return browse.node_counts(labelled), browse.edge_counts(edges)


def _collection(corpus: Corpus, collection: str, max_nodes: int | None) -> tuple[DataFrame, DataFrame]:
    asked = corpus.nodes.sparkSession.createDataFrame([(1, collection)], "query_id long, collection_id string")
    return browse.collection_subgraph(corpus, asked, max_nodes)


def graph_subgraph(corpus: Corpus, entity_id: str | None = None, hops: int = 2, collection: str | None = None,
                   max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with usage_count, edges) around an entity, of a collection, or of the whole graph; all, unless ``max_nodes`` asks for fewer.

    An unknown entity gives no rows. usage_count is null without usage.
    """
    if entity_id is None and collection is None:
        nodes, edges = browse.whole_graph(corpus.nodes, corpus.edges, max_nodes)
    else:
        if entity_id is None:
            edges, ids = _collection(corpus, collection, max_nodes)
        else:
            spark = corpus.nodes.sparkSession
            seeds = spark.createDataFrame([(1, entity_id)], "query_id long, node_id string")
            asked = spark.createDataFrame([(1, collection)], "query_id long, collection_id string")
            edges, ids = subgraphs(corpus, asked, seeds, hops, max_nodes=max_nodes)
        nodes = corpus.nodes.join(ids.select("node_id"), "node_id", "left_semi")
        edges = corpus.edges.join(edges.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_semi")
    shown = nodes.select("node_id")
    touching = corpus.edges.join(shown.withColumnRenamed("node_id", "dst"), "dst", "left_semi").unionByName(
        corpus.edges.join(shown.withColumnRenamed("node_id", "src"), "src", "left_semi")).distinct()
    # counts are global, but only the shown nodes' edges are read for them
    counts = browse.usage_counts(corpus.nodes, touching).join(shown, "node_id", "left_semi")
    return nodes.join(counts, "node_id", "left"), edges


def graph_export(corpus: Corpus, folder: str, collection: str | None = None) -> None:
    """Write the whole (scoped) graph as JSON lines."""
    nodes, edges = graph_subgraph(corpus, collection=collection)
    browse.graph_export(nodes, edges).write.partitionBy("kind").text(folder)


def dump(corpus: Corpus, folder: str) -> None:
    """Write all nodes, edges and vectors as JSON lines, without a limit."""
    for name in ("nodes", "edges", "entity_vectors", "entity_papers", "chunk_vectors"):
        getattr(corpus, name).write.json(f"{folder}/{name}")


def graph_entity(corpus: Corpus, entity_id: str, collection: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the entity with its usage, its relationships); both empty if unknown."""
    node = browse.by_id(corpus.nodes, "node_id", entity_id)
    own = corpus.edges.filter((F.col("src") == entity_id) | (F.col("dst") == entity_id))
    usage = browse.entity_usage(corpus.nodes.filter((F.col("node_id") == entity_id) | (F.col("label") == "Paper")), own)
    of = node.select("node_id")
    related = (browse.relationships(corpus.nodes, own, of) if collection is None
               else browse.relationships_in_collection(corpus.nodes, own, collection, of))
    return node.join(usage, "node_id"), related


def graph_search(corpus: Corpus, queries: DataFrame, label: str | None = None, limit: int = DEFAULTS.search_limit,
                 collection: str | None = None) -> DataFrame:
    """Ranked hits with names: queries(query_id, text)."""
    within = None if collection is None else in_collection(corpus.nodes, corpus.edges, collection)
    hits = search(searchable(corpus.nodes), queries, limit, None if label is None else [label], within)
    return hits.join(corpus.nodes.select("node_id", browse.shown_name().alias("name")), "node_id")


def stored_search(store: Snapshots, queries: DataFrame, label: str | None = None, limit: int = DEFAULTS.search_limit,
                  collection: str | None = None) -> DataFrame:
    """As ``graph_search`` over the index that a stored graph keeps."""
    nodes = store.read("nodes")
    within = None if collection is None else in_collection(nodes, store.read("edges"), collection)
    hits = search_stored(store, queries, limit, None if label is None else [label], within)
    return hits.join(nodes.select("node_id", browse.shown_name().alias("name")), "node_id")


def paper_list(papers: DataFrame, collection: str | None = None) -> DataFrame:
    return browse.newest_papers(papers, collection)


def paper_detail(corpus: Corpus, paper_id: str) -> tuple[DataFrame, DataFrame]:
    """(paper, its entities and relationships)."""
    node = corpus.nodes.filter((F.col("label") == "Paper") & (F.col("paper_id") == paper_id))
    entities = browse.paper_entities(corpus.nodes.filter((F.col("label") != "Paper") | (F.col("paper_id") == paper_id)), corpus.edges)
    return node, entities


def paper_delete(corpus: Corpus, paper_ids: DataFrame) -> dict[str, DataFrame]:
    return merge.delete_papers(corpus.papers, corpus.nodes, corpus.edges, corpus.chunk_vectors, corpus.entity_vectors,
                               corpus.entity_papers, paper_ids)


def collection_list(collections: DataFrame, papers: DataFrame) -> DataFrame:
    return browse.papers_per_collection(collections, papers)
