"""Registered queries: graph statistics, browsing, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import browse, traverse
from citeloom.operators import context as ctx
from citeloom.plans import domain as d
from citeloom.plans.domain_sql import using
from citeloom.plans.registry import query
from citeloom.runtime import counted, top_k_per_group

NAME_SQL = "coalesce(nullif(name, ''), nullif(title, ''), nullif(text, ''))"


@query("a1_node_counts", using("nodes") + """
    SELECT label, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT '(total)', count(*) FROM nodes""")
def node_counts(spark, sf):
    return browse.node_counts(d.corpus(spark, sf).nodes)


@query("a2_edge_counts", using("edges") + """
    SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type UNION ALL SELECT '(total)', count(*) FROM edges""")
def edge_counts(spark, sf):
    return browse.edge_counts(d.corpus(spark, sf).edges)


_USAGE = using("edges", "nodes") + """
    , usage AS (
    SELECT dst AS node_id, count(DISTINCT src) AS usage_count FROM edges JOIN nodes ON node_id = dst
    WHERE (label, rel_type) IN (('Method', 'USES_METHOD'), ('Dataset', 'EVALUATES_ON'), ('Author', 'AUTHORED_BY')) GROUP BY dst
    UNION ALL SELECT node_id, count(src) FROM nodes LEFT JOIN edges ON node_id IN (src, dst)
    AND src = node_id WHERE label = 'Paper' GROUP BY node_id)"""


@query("a4_usage_counts", _USAGE + " SELECT node_id, usage_count FROM usage")
def usage_counts(spark, sf):
    corpus = d.corpus(spark, sf)
    return browse.usage_counts(corpus.nodes, corpus.edges)


@query("a4_entity_usage", _USAGE + """
    SELECT node_id, CASE WHEN label <> 'Claim' THEN coalesce(usage_count, 0) END AS usage_count
    FROM nodes LEFT JOIN usage USING (node_id)""")
def entity_usage(spark, sf):
    corpus = d.corpus(spark, sf)
    return browse.entity_usage(corpus.nodes, corpus.edges)


@query("g13_node_size", _USAGE + """
    SELECT node_id, CASE WHEN label = 'Claim' THEN 30 ELSE CAST(floor(least(70.0, 24 + sqrt(coalesce(usage_count, 0)) * 10) + 0.5) AS INTEGER) END AS size,
           CASE WHEN label = 'Claim' THEN 18 ELSE CAST(floor(least(40.0, 14 + sqrt(coalesce(usage_count, 0)) * 6) + 0.5) AS INTEGER) END AS compact_size
    FROM nodes LEFT JOIN usage USING (node_id)""")
def node_size(spark, sf):
    corpus = d.corpus(spark, sf)
    counted = corpus.nodes.select("node_id", "label").join(browse.usage_counts(corpus.nodes, corpus.edges), "node_id", "left")
    return counted.select("node_id", browse.node_size(F.col("label"), F.col("usage_count")).alias("size"),
                          browse.node_size(F.col("label"), F.col("usage_count"), compact=True).alias("compact_size"))


@query("g14_edge_label", using("edges") + """
    SELECT src, dst, rel_type, CASE rel_type WHEN 'EVALUATES_ON' THEN metric || ' ' || value WHEN 'INTRODUCES' THEN 'introduces' ELSE '' END AS caption
    FROM edges""")
def edge_label(spark, sf):
    e = d.corpus(spark, sf).edges
    return e.select("src", "dst", "rel_type",
                    browse.edge_label(F.col("rel_type"), F.col("metric"), F.col("value"), F.col("margin")).alias("caption"))


@query("j1_paper_entities", using("edges", "nodes") + """
    SELECT DISTINCT p.paper_id, n.node_id AS entity_id, n.label, coalesce(n.name, n.text) AS name, rel_type, src = p.node_id AS from_paper, confidence
    FROM nodes p JOIN edges ON p.node_id IN (src) JOIN nodes n ON n.node_id = dst WHERE p.label = 'Paper' AND n.label <> 'Paper'""")
def paper_entities(spark, sf):
    corpus = d.corpus(spark, sf)
    return browse.paper_entities(corpus.nodes, corpus.edges)


@query("j2_entity_relationships", using("ends", "nodes") + f"""
    SELECT e.node_id, CASE WHEN src = e.node_id THEN 'outgoing' ELSE 'incoming' END AS direction, other AS other_id,
           label AS other_label, {NAME_SQL} AS other_name, rel_type, confidence
    FROM ends e JOIN nodes n ON n.node_id = other WHERE rel_type <> 'AUTHORED_BY'""")
def entity_relationships(spark, sf):
    corpus = d.corpus(spark, sf)
    kept = corpus.edges.filter(F.col("rel_type") != "AUTHORED_BY").select("src", "dst", "rel_type", "confidence")
    return browse.relationships(corpus.nodes, kept)


@query("p8_relationships_in_collection", using("ends", "nodes") + f"""
    SELECT e.node_id, CASE WHEN src = e.node_id THEN 'outgoing' ELSE 'incoming' END AS direction, other AS other_id,
           label AS other_label, {NAME_SQL} AS other_name, rel_type, confidence
    FROM ends e JOIN nodes n ON n.node_id = other
    WHERE label NOT IN ('Paper', 'Claim') OR (label = 'Paper' AND collection_id = '2-HIGH')
       OR (label = 'Claim' AND source_paper_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '2-HIGH'))""")
def relationships_in_collection(spark, sf):
    corpus = d.corpus(spark, sf)
    return browse.relationships_in_collection(
        corpus.nodes, corpus.edges.select("src", "dst", "rel_type", "confidence"), "2-HIGH")


@query("s8_whole_graph_nodes", using("nodes") + """
    SELECT node_id, label, coalesce(name, title, text) AS name FROM nodes ORDER BY node_id LIMIT 150""")
def whole_graph_nodes(spark, sf):
    corpus = d.corpus(spark, sf)
    shown, _ = browse.whole_graph(corpus.nodes, corpus.edges, 150)
    return shown.select("node_id", "label", browse.shown_name().alias("name"))


@query("s9_induced_edges", using("nodes", "edges") + """
    , shown AS (SELECT node_id FROM nodes)
    SELECT src, dst, rel_type FROM edges WHERE src IN (SELECT node_id FROM shown) AND dst IN (SELECT node_id FROM shown)""")
def induced_edges(spark, sf):
    corpus = d.corpus(spark, sf)
    return browse.whole_graph(corpus.nodes, corpus.edges)[1].select("src", "dst", "rel_type")


@query("s10_entity_by_id", using("nodes") + """
    SELECT n.node_id, label, name FROM nodes n JOIN (SELECT 'p:' || max(p_partkey) AS node_id FROM part) USING (node_id)""")
def entity_by_id(spark, sf):
    newest = d.table(spark, sf, "part").agg(F.concat(F.lit("p:"), F.max("p_partkey").cast("string"))).first()[0]
    return browse.by_id(d.corpus(spark, sf).nodes, "node_id", newest).select("node_id", "label", "name")


@query("s11_candidate_entities", using("nodes") + """
    SELECT node_id, label AS entity_type, name FROM nodes WHERE label IN ('Method', 'Dataset') ORDER BY node_id LIMIT 500""")
def candidate_entities(spark, sf):
    kept = d.corpus(spark, sf).nodes.filter(F.col("label").isin("Method", "Dataset"))
    return browse.page(kept, "node_id", 500).select("node_id", F.col("label").alias("entity_type"), "name")


@query("s16_collection_papers", using("nodes") + """
    SELECT collection_id, paper_id FROM nodes WHERE label = 'Paper' AND collection_id = '1-URGENT'""")
def collection_papers(spark, sf):
    return d.corpus(spark, sf).nodes.filter((F.col("label") == "Paper") & (F.col("collection_id") == "1-URGENT")).select(
        "collection_id", "paper_id")


@query("s7_newest_papers", """
    SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM orders WHERE o_orderpriority = '5-LOW'""")
def newest_papers(spark, sf):
    papers = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("paper_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderpriority").alias("collection_id"))
    return browse.newest_papers(papers, "5-LOW").select("paper_id", F.unix_seconds("created_at").alias("created"))


@query("s6_paged_scan", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def paged_scan(spark, sf):
    """The third page of fifty, each asked for by where the one before ended."""
    customers, after = d.table(spark, sf, "customer").select("c_custkey", "c_name"), None
    for _ in range(2):
        after = browse.last_key(browse.page(customers, "c_custkey", 50, after), "c_custkey")
    return browse.page(customers, "c_custkey", 50, after)


_SHOWN_SQL = using("nodes", "edges") + """
    , asked AS (SELECT DISTINCT o_orderpriority AS wanted FROM orders),
    met AS (SELECT wanted, src, dst, rel_type, coalesce(confidence, 0) AS conf FROM asked, edges
            WHERE src IN (SELECT node_id FROM nodes WHERE collection_id = wanted)
               OR dst IN (SELECT dst FROM edges JOIN nodes ON node_id = src WHERE collection_id = wanted)),
    cut AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY conf DESC, src, dst, rel_type) AS ord FROM met QUALIFY ord <= 2000),
    inside AS (SELECT * FROM cut JOIN nodes ON node_id = src AND collection_id = wanted),
    seen AS (SELECT wanted, node_id, min(ord) AS ord FROM (SELECT wanted, src AS node_id, ord FROM inside UNION ALL SELECT wanted, dst, ord FROM inside) GROUP BY ALL),
    fits AS (SELECT wanted, node_id, count(*) OVER (PARTITION BY wanted ORDER BY ord RANGE UNBOUNDED PRECEDING) AS upto FROM seen),
    kept AS (SELECT wanted, node_id FROM fits WHERE upto <= 150),
    short AS (SELECT wanted FROM kept GROUP BY wanted HAVING count(*) = 149),
    last AS (SELECT wanted, arg_min(CASE WHEN dst IN (SELECT node_id FROM kept k WHERE k.wanted = i.wanted) THEN src ELSE dst END, ord) AS node_id
             FROM inside i WHERE wanted IN (SELECT wanted FROM short)
               AND (src IN (SELECT node_id FROM kept k WHERE k.wanted = i.wanted)) <> (dst IN (SELECT node_id FROM kept k WHERE k.wanted = i.wanted))
             GROUP BY wanted),
    shown AS (SELECT wanted, node_id FROM kept UNION ALL SELECT wanted, node_id FROM last)"""


@query("g9_collection_subgraph", _SHOWN_SQL + " SELECT wanted AS collection_id, node_id FROM shown")
def collection_subgraph(spark, sf):
    return _collection_graph(spark, sf)[1].select(F.col("query_id").alias("collection_id"), "node_id")


_SHOWN: dict[tuple[str, str], tuple] = {}


def _collection_graph(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SHOWN:
        names = d.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("collection_id")).distinct()
        _SHOWN[key] = browse.collection_subgraph(d.corpus(spark, sf), names.withColumn("query_id", F.col("collection_id")), max_nodes=150, row_limit=2000)
    return _SHOWN[key]


@query("a3_collection_counts", _SHOWN_SQL + """
    SELECT wanted AS collection_id, 'node' AS kind, label AS name, count(*) AS n FROM shown JOIN nodes USING (node_id) GROUP BY ALL
    UNION ALL SELECT i.wanted, 'edge', rel_type, count(*) FROM inside i JOIN shown a ON a.wanted = i.wanted AND a.node_id = i.src
    JOIN shown b ON b.wanted = i.wanted AND b.node_id = i.dst GROUP BY ALL""")
def collection_counts(spark, sf):
    edges, nodes = _collection_graph(spark, sf)
    return browse.subgraph_counts(edges, nodes, d.corpus(spark, sf).nodes).withColumnRenamed("query_id", "collection_id")


@query("a3_collection_counts_exact", using("nodes", "edges") + """
    SELECT collection_id, rel_type, count(*) AS n FROM edges JOIN nodes ON node_id = src GROUP BY ALL""")
def collection_counts_exact(spark, sf):
    corpus = d.corpus(spark, sf)
    papers = corpus.nodes.filter(F.col("label") == "Paper").select(F.col("node_id").alias("src"), "collection_id")
    return corpus.edges.select("src", "rel_type").join(papers, "src").groupBy("collection_id", "rel_type").agg(
        F.count("*").alias("n"))


@query("g10_orphans", using("nodes", "edges") + """
    SELECT label, count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT src FROM edges WHERE rel_type = 'REPORTS_RESULT' UNION SELECT dst FROM edges WHERE rel_type = 'REPORTS_RESULT')
    GROUP BY label""")
def orphans(spark, sf):
    corpus = d.corpus(spark, sf)
    reports = corpus.edges.filter(F.col("rel_type") == "REPORTS_RESULT")
    return browse.orphans(corpus.nodes, reports).groupBy("label").agg(F.count("*").alias("n"))


@query("g11_neighbours", using("ends") + """
    SELECT DISTINCT node_id, other FROM ends WHERE node_id LIKE 's:%'""")
def neighbours(spark, sf):
    corpus = d.corpus(spark, sf)
    return browse.neighbour_ids(corpus.edges, corpus.nodes.filter(F.col("label") == "Dataset"))


@query("g12_expand", using("nodes", "edges") + """
    , shown AS (SELECT src, dst, rel_type FROM edges WHERE rel_type = 'INTRODUCES'),
    more AS (SELECT src, dst, rel_type FROM edges WHERE rel_type IN ('INTRODUCES', 'AUTHORED_BY'))
    SELECT 'edge' AS kind, count(*) AS n FROM (SELECT * FROM shown UNION SELECT * FROM more)
    UNION ALL SELECT 'node', count(*) FROM (SELECT src FROM shown UNION SELECT dst FROM shown UNION SELECT src FROM more UNION SELECT dst FROM more)""")
def expand(spark, sf):
    e = d.corpus(spark, sf).edges.select("src", "dst", "rel_type")

    def ids(edges):
        return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()

    shown = e.filter(F.col("rel_type") == "INTRODUCES")
    more = e.filter(F.col("rel_type").isin("INTRODUCES", "AUTHORED_BY"))
    nodes, edges = browse.expand(ids(shown), shown, ids(more), more)
    return edges.groupBy(F.lit("edge").alias("kind")).agg(F.count("*").alias("n")).unionByName(
        nodes.groupBy(F.lit("node").alias("kind")).agg(F.count("*").alias("n")))


@query("p24_visible_nodes", using("nodes", "edges") + f"""
    SELECT n.node_id, label FROM nodes n WHERE (label NOT IN ('Claim', 'Dataset') OR node_id IN (
        SELECT dst FROM edges JOIN nodes p ON p.node_id = src WHERE p.collection_id = '3-MEDIUM'))
      AND contains(lower({NAME_SQL}), '12')""")
def visible_nodes(spark, sf):
    corpus = d.corpus(spark, sf)
    revealed = corpus.nodes.filter(F.col("collection_id") == "3-MEDIUM").select("node_id")
    return browse.visible_nodes(corpus.nodes, corpus.edges, ["Claim", "Dataset"], revealed, "12").select("node_id", "label")


@query("p25_cited_entities", using("nodes", "edges") + """
    SELECT DISTINCT n.node_id, n.label FROM nodes n JOIN edges ON dst = n.node_id JOIN nodes p ON p.node_id = src
    WHERE n.label <> 'Paper' AND p.label = 'Paper' AND p.venue = 'F'""")
def cited_entities(spark, sf):
    corpus = d.corpus(spark, sf)
    cited = d.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").cast("string").alias("paper_id"))
    return browse.cited_entities(corpus.nodes, corpus.edges, cited).select("node_id", "label")


@query("p2_display_name", using("nodes") + f"SELECT node_id, {NAME_SQL} AS name FROM nodes")
def display_name(spark, sf):
    return d.corpus(spark, sf).nodes.select("node_id", browse.shown_name().alias("name"))


@query("p1_without_embedding", "SELECT vec_id, label FROM embeddings")
def without_embedding(spark, sf):
    return d.table(spark, sf, "embeddings").drop("embedding")


@query("j8_introduced_by_all", using("nodes", "edges") + """
    SELECT CAST(0 AS BIGINT) AS query_id, dst AS node_id, arg_max(title, src) AS intro_title, arg_max(year, src) AS intro_year
    FROM edges JOIN nodes ON node_id = src WHERE rel_type = 'INTRODUCES' GROUP BY dst""")
def introduced_by_all(spark, sf):
    corpus = d.corpus(spark, sf)
    zero = F.lit(0).cast("long").alias("query_id")
    return ctx.introduced_by(corpus.nodes.select("*", zero), corpus.edges.select("*", zero, F.col("src").alias("ord")))


@query("j12_in_collection_exists", using("nodes", "ends") + """
    SELECT n.node_id FROM nodes n WHERE label IN ('Method', 'Dataset', 'Author') AND EXISTS (
        SELECT 1 FROM ends e JOIN nodes p ON p.node_id = other WHERE e.node_id = n.node_id AND p.collection_id = '4-NOT SPECIFIED')""")
def in_collection_exists(spark, sf):
    corpus = d.corpus(spark, sf)
    papers = corpus.nodes.filter(F.col("collection_id") == "4-NOT SPECIFIED").select("node_id")
    near = browse.neighbour_ids(corpus.edges, papers).select(F.col("other").alias("node_id"))
    return corpus.nodes.filter(F.col("label").isin("Method", "Dataset", "Author")).join(near, "node_id", "left_semi").select("node_id")


@query("j15_degree", using("nodes", "edges") + """
    SELECT node_id, count(src) AS degree FROM nodes LEFT JOIN edges ON src = node_id WHERE label = 'Paper' GROUP BY node_id""")
def degree(spark, sf):
    corpus = d.corpus(spark, sf)
    return browse.usage_counts(corpus.nodes, corpus.edges).join(
        corpus.nodes.filter(F.col("label") == "Paper").select("node_id"), "node_id", "left_semi"
    ).withColumnRenamed("usage_count", "degree")


@query("e2_known_types", using("edges") + """
    SELECT rel_type, count(*) AS n FROM edges WHERE rel_type IN ('USES_METHOD') GROUP BY rel_type""")
def known_types(spark, sf):
    return traverse.of_types(d.corpus(spark, sf).edges, ["USES_METHOD", "MADE_UP"]).groupBy("rel_type").agg(
        F.count("*").alias("n"))


@query("e6_distinct_relations", using("ends") + """
    SELECT node_id, count(DISTINCT (src, dst, rel_type)) AS n FROM ends GROUP BY node_id""")
def distinct_relations(spark, sf):
    e = d.corpus(spark, sf).edges
    return counted(browse.oriented(e.select("src", "dst", "rel_type")), "node_id")


@query("t7_label_order", using("nodes") + """
    SELECT label, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN list_position(['Method', 'Dataset', 'Paper', 'Author', 'Metric', 'Claim'], label) > 0
        THEN list_position(['Method', 'Dataset', 'Paper', 'Author', 'Metric', 'Claim'], label) ELSE 7 END, label) AS place
    FROM nodes GROUP BY label""")
def label_order(spark, sf):
    counts = d.corpus(spark, sf).nodes.groupBy("label").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return top_k_per_group(counts, ["one"], [ctx.label_order(F.col("label")), F.col("label")], 100, "place").drop("one")


@query("f23_palette_slot", using("nodes") + """
    SELECT node_id, CAST(abs(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(node_id, ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda h, c: xor(CASE WHEN (h * 33) & 4294967295 >= 2147483648 THEN ((h * 33) & 4294967295) - 4294967296 ELSE (h * 33) & 4294967295 END, c))) % 8 AS INTEGER) AS slot
    FROM nodes""")
def palette_slot(spark, sf):
    return d.corpus(spark, sf).nodes.select("node_id", browse.palette_slot(F.col("node_id")).alias("slot"))


@query("f24_confidence_band", using("edges") + """
    SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
    FROM edges WHERE confidence IS NOT NULL GROUP BY band""")
def confidence_band(spark, sf):
    e = d.corpus(spark, sf).edges.filter(F.col("confidence").isNotNull())
    return e.groupBy(browse.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("k23_graph_export", using("nodes", "edges") + """
    , shown AS (SELECT node_id, label, name, title, text FROM nodes)
    SELECT 'node' AS kind, count(*) AS n FROM shown UNION ALL
    SELECT 'edge', count(*) FROM edges WHERE src IN (SELECT node_id FROM shown) AND dst IN (SELECT node_id FROM shown)""")
def graph_export(spark, sf):
    corpus = d.corpus(spark, sf)
    nodes, edges = browse.whole_graph(corpus.nodes, corpus.edges)
    return browse.graph_export(nodes, edges).filter(F.col("json").isNotNull()).groupBy("kind").agg(F.count("*").alias("n"))


@query("a5_papers_per_collection", """
    SELECT n_name AS collection_id, count(o_orderkey) AS paper_count FROM nation
    LEFT JOIN (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') ON c_nationkey = n_nationkey GROUP BY n_name""")
def papers_per_collection(spark, sf):
    n = d.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("collection_id"))
    c = d.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_nationkey")
    papers = (
        d.table(spark, sf, "orders").select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("collection_id")
    )
    return browse.papers_per_collection(n.select("collection_id"), papers)


@query("a7_status_counts", """
    SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed,
           count(*) FILTER (o_orderstatus = 'P') AS in_progress, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders""")
def status_counts(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("failed")
    return browse.status_counts(d.table(spark, sf, "orders").select(status.alias("status")))
