"""Graph and catalogue views: counts, details, neighbourhoods, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.context import filled
from citeloom.operators.retrieve import Corpus, subgraphs
from citeloom.operators.traverse import both_ways
from citeloom.runtime import written
from citeloom.settings import DEFAULTS

# The relation that counts as usage of a label.
USAGE_RELATION = {"Method": "USES_METHOD", "Dataset": "EVALUATES_ON", "Author": "AUTHORED_BY"}


def shown_name() -> Column:
    """First non-empty of canonical name, title, text."""
    return filled(F.col("name"), F.col("title"), F.col("text"))


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per label with the total over labelled nodes."""
    return _with_total(nodes.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n")), "label")


def edge_counts(edges: DataFrame) -> DataFrame:
    return _with_total(edges.groupBy("rel_type").agg(F.count("*").alias("n")), "rel_type")


def _with_total(counts: DataFrame, key: str) -> DataFrame:
    """Adds the "(total)" row through a rollup over the few group rows, not the data."""
    return counts.rollup(key).agg(F.sum("n").alias("n")).withColumn(key, F.coalesce(key, F.lit("(total)")))


def usage_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, usage_count) over the whole graph, whatever collection is shown.

    Methods, datasets and authors count the papers that use them and are absent
    without one; papers count their edges and are always present.
    """
    wanted = F.create_map(*[F.lit(x) for pair in USAGE_RELATION.items() for x in pair])
    labels = nodes.select(F.col("node_id").alias("dst"), F.col("label"))
    papers = nodes.filter(F.col("label") == "Paper").select(F.col("node_id").alias("src"))
    # edges are unique per (src, dst, type), so counting them counts distinct papers;
    # they are counted per end before any join on it, as one end may hold most of them
    counted = (
        edges.filter(F.col("rel_type").isin(*USAGE_RELATION.values())).select("src", "dst", "rel_type")
        .join(papers, "src", "left_semi")
        .groupBy("dst", "rel_type").agg(F.count("*").alias("usage_count"))
    )
    used = counted.join(labels, "dst").filter(wanted[F.col("label")] == F.col("rel_type")).select(
        F.col("dst").alias("node_id"), "usage_count"
    )
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
    degree = ends.groupBy("node_id").agg(F.count("*").alias("n"))
    of_papers = papers.select(F.col("src").alias("node_id")).join(degree, "node_id", "left").select(
        "node_id", F.coalesce("n", F.lit(0)).alias("usage_count")
    )
    return used.unionByName(of_papers)


def entity_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Usage for entity details: 0 instead of absent for countable labels, null for the rest."""
    countable = F.col("label").isin("Paper", *USAGE_RELATION)
    return nodes.select("node_id", "label").join(usage_counts(nodes, edges), "node_id", "left").select(
        "node_id", F.when(countable, F.coalesce("usage_count", F.lit(0))).alias("usage_count")
    )


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: (node_id, other_id, direction, ...); a self-loop once."""
    carried = [c for c in edges.columns if c not in ("src", "dst")]
    views = F.filter(
        F.array(
            F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other_id"), F.lit("outgoing").alias("direction")),
            F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other_id"), F.lit("incoming").alias("direction")),
        ),
        lambda v: (v["direction"] == "outgoing") | (v["node_id"] != v["other_id"]),
    )
    return edges.select(*carried, F.inline(views))


def relationships(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Relationships of entities (all, or those in of(node_id)) with the other end's label and name."""
    seen = oriented(edges)
    if of is not None:
        seen = seen.join(of.select("node_id"), "node_id", "left_semi")
    others = nodes.select(
        F.col("node_id").alias("other_id"), F.col("label").alias("other_label"), shown_name().alias("other_name")
    )
    return seen.join(others, "other_id")


def relationships_in_collection(nodes: DataFrame, edges: DataFrame, collection: str, of: DataFrame | None = None) -> DataFrame:
    """Relationships whose other end is no paper or claim, or one of this collection."""
    papers = nodes.filter((F.col("label") == "Paper") & (F.col("collection_id") == collection))
    ours = papers.select(F.col("paper_id").alias("source_paper_id"), F.lit(True).alias("ours")).distinct()
    visible = (
        nodes.join(ours, "source_paper_id", "left")
        .filter(
            ~F.col("label").isin("Paper", "Claim")
            | ((F.col("label") == "Paper") & (F.col("collection_id") == collection))
            | ((F.col("label") == "Claim") & F.col("ours"))
        )
    )
    return relationships(visible.select(*nodes.columns), edges, of)


def paper_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Non-paper neighbours of every paper with relation and direction; distinct because edges are."""
    papers = nodes.filter(F.col("label") == "Paper").select("node_id", "paper_id")
    entities = nodes.filter(F.col("label") != "Paper").select(
        F.col("node_id").alias("entity_id"), "label", filled(F.col("name"), F.col("text")).alias("name")
    )
    return (
        oriented(edges.select("src", "dst", "rel_type", "confidence"))
        .join(papers, "node_id")
        .withColumnRenamed("other_id", "entity_id")
        .join(entities, "entity_id")
        .select("paper_id", "entity_id", "label", "name", "rel_type",
                (F.col("direction") == "outgoing").alias("from_paper"), "confidence")
    )


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids(node_id)."""
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
    return edges


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, for nodes that hold nearly all ends.

    The distinct ends are looked up, not the edges; those that are no nodes, few or
    none, then take their edges out.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    unknown = written(ends.join(nodes.select("node_id"), "node_id", "left_anti"), "unknown-ends")
    edges = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    for end in ("src", "dst"):
        edges = edges.join(unknown.select(F.col("node_id").alias(end)), end, "left_anti")
    return edges


def whole_graph(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All nodes, or the first ``limit`` by id, and the edges among them."""
    if limit is None:
        return nodes, known_edges(edges, nodes)
    shown = nodes.orderBy("node_id").limit(limit)
    return shown, induced_edges(edges, shown)


def collection_subgraph(corpus: Corpus, collections: DataFrame, max_nodes: int | None = None, row_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """2-hop subgraph seeded by all papers of each collection: (edges, nodes) keyed by query_id.

    collections(query_id, collection_id).
    """
    seeds = (
        corpus.nodes.filter(F.col("label") == "Paper").select("node_id", "collection_id")
        .join(collections, "collection_id").select("query_id", "node_id")
    )
    return subgraphs(corpus, collections, seeds, hops=2, max_nodes=max_nodes, row_limit=row_limit)


def subgraph_counts(edges: DataFrame, nodes: DataFrame, described: DataFrame) -> DataFrame:
    """Per query: node counts by label and edge counts by type, as (query_id, kind, name, n)."""
    by_label = nodes.join(described.select("node_id", "label"), "node_id").groupBy(
        "query_id", F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    by_type = edges.groupBy("query_id", F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(
        F.count("*").alias("n"))
    return by_label.unionByName(by_type)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return nodes.join(ends.distinct(), "node_id", "left_anti")


def neighbour_ids(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Distinct (node_id, other) neighbours of the given nodes."""
    return both_ways(edges).join(of.select("node_id"), "node_id", "left_semi").distinct()


def expand(shown_nodes: DataFrame, shown_edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge a further fetch into a shown graph; known ids and edges stay as they are."""
    new_nodes = more_nodes.join(shown_nodes.select("node_id"), "node_id", "left_anti")
    new_edges = more_edges.join(shown_edges.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_anti")
    return shown_nodes.unionByName(new_nodes), shown_edges.unionByName(new_edges)


def visible_nodes(nodes: DataFrame, edges: DataFrame, hidden_labels: list[str], revealed: DataFrame | None = None,
                  search: str | None = None) -> DataFrame:
    """Nodes a viewer sees: hidden labels drop out unless a revealed node touches them."""
    keep = ~F.col("label").isin(*hidden_labels) if hidden_labels else F.lit(True)
    marked = nodes
    if revealed is not None:
        near = neighbour_ids(edges, revealed).select(F.col("other").alias("node_id")).distinct().withColumn("near", F.lit(True))
        marked = nodes.join(near, "node_id", "left")
        keep = keep | F.coalesce("near", F.lit(False))
    seen = marked.filter(keep).select(*nodes.columns)
    if search:
        seen = seen.filter(F.contains(F.lower(F.coalesce(shown_name(), F.lit(""))), F.lit(search.lower())))
    return seen


def cited_entities(nodes: DataFrame, edges: DataFrame, cited: DataFrame) -> DataFrame:
    """Non-paper nodes with an edge to a cited paper: cited(paper_id)."""
    papers = nodes.filter(F.col("label") == "Paper").join(cited, "paper_id", "left_semi").select("node_id")
    near = neighbour_ids(edges, papers).select(F.col("other").alias("node_id")).distinct()
    return nodes.filter(F.col("label") != "Paper").join(near, "node_id", "left_semi")


def node_size(label: Column, usage: Column, compact: bool = False) -> Column:
    """Display size: fixed for claims, else growing with the root of the usage."""
    base, top, scale = (14, 40, 6) if compact else (24, 70, 10)
    grown = F.least(F.lit(float(top)), base + F.sqrt(F.coalesce(usage, F.lit(0)).cast("double")) * scale)
    return F.when(label == "Claim", F.lit(18 if compact else 30)).otherwise(F.floor(grown + 0.5).cast("int"))


def edge_label(rel_type: Column, metric: Column, value: Column, margin: Column) -> Column:
    """Short caption of an edge; empty for types without one."""
    some = lambda c: F.nullif(c, F.lit(""))
    return (
        F.when(rel_type == "EVALUATES_ON", F.concat_ws(" ", some(metric), some(value)))
        .when((rel_type == "OUTPERFORMS") & (F.coalesce(margin, F.lit("")) != ""), F.concat(F.lit("outperforms "), margin))
        .when(rel_type.isin("EXTENDS", "CONTRADICTS", "OUTPERFORMS", "INTRODUCES"), F.lower(rel_type))
        .otherwise(F.lit(""))
    )


def palette_slot(key: Column, slots: int = 8) -> Column:
    """Stable slot of an id: multiply-xor over code units in signed 32-bit arithmetic for the xor."""
    def step(acc: Column, unit: Column) -> Column:
        wide = acc * F.lit(33).cast("long")
        low = F.pmod(wide, F.lit(1 << 32))
        signed = F.when(low >= (1 << 31), low - (1 << 32)).otherwise(low)
        return signed.bitwiseXOR(unit)

    units = F.transform(F.split(key, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.pmod(F.abs(F.aggregate(units, F.lit(5381).cast("long"), step)), F.lit(slots)).cast("int")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def papers_per_collection(collections: DataFrame, papers: DataFrame) -> DataFrame:
    counts = papers.groupBy("collection_id").agg(F.count("*").alias("paper_count"))
    return collections.join(counts, "collection_id", "left").na.fill(0, ["paper_count"])


def status_counts(papers: DataFrame, status: str = "status") -> DataFrame:
    """total, completed, in progress, failed in one pass."""
    s = F.col(status)
    return papers.agg(
        F.count("*").alias("total"),
        F.count_if(s == "completed").alias("completed"),
        F.count_if(s.isin("pending", "processing")).alias("in_progress"),
        F.count_if(s == "failed").alias("failed"),
    )


def page(df: DataFrame, key: str, limit: int = 100, after=None) -> DataFrame:
    """The first ``limit`` rows by a unique key, or those that follow the key a page ended with.

    The filter reaches the scan and every task keeps ``limit`` rows, so a late page
    costs no more than the first.
    """
    left = df if after is None else df.filter(F.col(key) > F.lit(after))
    return left.orderBy(key).limit(limit)


def last_key(rows: DataFrame, key: str):
    """Where a page ends; null for an empty one."""
    return rows.agg(F.max(key)).first()[0]


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def newest_papers(papers: DataFrame, collection: str | None = None) -> DataFrame:
    kept = papers if collection is None else papers.filter(F.col("collection_id") == collection)
    return kept.orderBy(F.desc("created_at"), "paper_id")


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge, ready to be written as text; nothing is gathered."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))
