"""Ranked keyword search over node texts (BM25 per label, k1=1.2, b=0.75)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import top_k_per_group, written
from citeloom.settings import DEFAULTS, SEARCH_LABELS

K1, B = 1.2, 0.75
SLACK = 1e-5  # scores are compared after rounding to 6 digits


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def weight(tf: Column, n_words: Column, df: Column) -> Column:
    """What a word adds to a node's score; ``n_docs`` and ``mean_words`` are columns of the row."""
    rare = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
    return rare * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words / F.col("mean_words"))))


def searchable(nodes: DataFrame) -> DataFrame:
    """(node_id, label, text) of the labels that carry an index: names, titles, texts, abstracts and descriptions."""
    held = [c for c in ("name", "title", "text", "abstract", "description") if c in nodes.columns]
    return nodes.filter(F.col("label").isin(*SEARCH_LABELS)).select("node_id", "label", F.concat_ws(" ", *held).alias("text"))


def search(
    texts: DataFrame, queries: DataFrame, limit: int = DEFAULTS.search_limit, labels: list[str] | None = None,
    within: DataFrame | None = None,
) -> DataFrame:
    """Top ``limit`` nodes per query: (query_id, node_id, label, score, rank).

    texts(node_id, label, text); queries(query_id, text); within(node_id)
    restricts the hits, not the statistics. Only words some query asks for are
    ever exploded into rows, and they are counted before they are shuffled.
    """
    if labels is not None:
        unknown = set(labels) - set(SEARCH_LABELS)
        if unknown:
            raise ValueError(f"unknown entity type: {sorted(unknown)}")
        texts = texts.filter(F.col("label").isin(*labels))
    asked = written(
        queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")), "terms"
    )
    words = texts.select("node_id", "label", terms(F.col("text")).alias("words"))
    sizes = words.groupBy("label").agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("mean_words"))
    vocabulary = asked.select("term").distinct()
    postings = written(
        words.select("node_id", "label", F.size("words").alias("n_words"), F.explode("words").alias("term"))
        .join(vocabulary, "term", "left_semi")
        .groupBy("label", "node_id", "n_words", "term").agg(F.count("*").alias("tf")),
        "postings",
    )
    # a row per asked word: the postings are never joined on their label alone
    facts = written(postings.groupBy("label", "term").agg(F.count("*").alias("df")).join(sizes, "label"), "facts")
    hits = postings if within is None else postings.join(within.select("node_id"), "node_id", "left_semi")
    added = weight(F.col("tf"), F.col("n_words"), F.col("df"))
    weighted = written(hits.join(facts, ["label", "term"]).select("label", "node_id", "term", added.alias("w")), "weighted")
    best = written(weighted.groupBy("label", "term").agg(F.max("w").alias("best"), F.count("*").alias("held")), "best")
    same = alike(asked, best)
    chosen = _candidates(weighted, asked, best, same, limit)
    scored = (
        chosen.join(weighted, ["label", "node_id"]).join(asked, ["query_id", "term"])
        .groupBy("query_id", "label", "node_id").agg(F.round(F.sum("w"), 6).alias("score"))
    )
    order = [F.desc("score"), F.col("node_id")]
    per_label = top_k_per_group(scored, ["query_id", "label"], order, limit, "_in_label").drop("_in_label")
    return top_k_per_group(for_all(per_label, same), ["query_id"], order, limit, "rank")


def alike(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, label, leader): queries that ask a label for the same words it holds share one ranking.

    asked(query_id, term), held(label, term). However many queries share common words,
    the nodes that hold them are paired with one query of each kind.
    """
    asking = asked.filter(F.col("query_id").isNotNull()).join(held.select("label", "term"), "term")
    words = asking.groupBy("query_id", "label").agg(F.sort_array(F.collect_list("term")).alias("words"))
    leaders = words.groupBy("label", "words").agg(F.min("query_id").alias("leader"))
    return written(words.join(leaders, ["label", "words"]).select("query_id", "label", "leader"), "alike")


def leading(same: DataFrame) -> DataFrame:
    return same.filter(F.col("query_id") == F.col("leader")).select("query_id", "label")


def for_all(per_label: DataFrame, same: DataFrame) -> DataFrame:
    """The rankings of the leading queries for every query."""
    return same.join(per_label.withColumnRenamed("query_id", "leader"), ["leader", "label"]).select(
        "query_id", "label", "node_id", "score")


def _candidates(weighted: DataFrame, asked: DataFrame, best: DataFrame, same: DataFrame, limit: int) -> DataFrame:
    """(query_id, label, node_id) of leading queries that can still reach the top ``limit`` of their label.

    A query's terms are ordered by the best weight they give any node. The
    first ones, up to one that ``limit`` nodes hold, give every query a score
    its top nodes reach at least. Nodes that hold only later terms whose best
    weights together stay below that score are out, so common words never
    pair a query with all nodes.
    """
    by_best = Window.partitionBy("query_id", "label").orderBy(F.desc("best"), "term")
    terms_of = asked.join(best, "term").join(leading(same), ["query_id", "label"], "left_semi").select(
        "query_id", "label", "term",
        F.sum("best").over(by_best.rowsBetween(0, Window.unboundedFollowing)).alias("still_possible"),
        F.coalesce(
            F.max((F.col("held") >= limit).cast("int")).over(by_best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("enough_before"),
    )
    terms_of = written(terms_of, "query-terms")
    probed = (
        terms_of.filter("enough_before = 0").join(weighted, ["label", "term"])
        .groupBy("query_id", "label", "node_id").agg(F.sum("w").alias("part"))
    )
    reached = (
        top_k_per_group(probed, ["query_id", "label"], [F.desc("part"), F.col("node_id")], limit, "_place")
        .filter(F.col("_place") == limit).select("query_id", "label", F.col("part").alias("reached"))
    )
    deciding = written(terms_of.join(reached, ["query_id", "label"], "left").filter(
        F.col("still_possible") >= F.coalesce("reached", F.lit(0.0)) - SLACK
    ).select("query_id", "label", "term"), "deciding")
    return deciding.join(weighted, ["label", "term"]).select(
        "query_id", "label", "node_id").distinct()


def in_collection(nodes: DataFrame, edges: DataFrame, collection: str) -> DataFrame:
    """Nodes a search scoped to the collection may return."""
    papers = nodes.filter((F.col("label") == "Paper") & (F.col("collection_id") == collection))
    ids = papers.select("node_id")
    claims = nodes.filter(F.col("label") == "Claim").join(
        papers.select(F.col("paper_id").alias("source_paper_id")), "source_paper_id", "left_semi").select("node_id")
    linked = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id")).unionByName(
        edges.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("node_id")))
    shared = nodes.filter(F.col("label").isin("Method", "Dataset", "Author")).join(linked, "node_id", "left_semi").select("node_id")
    return ids.unionByName(claims).unionByName(shared)
