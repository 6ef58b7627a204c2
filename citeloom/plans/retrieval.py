"""Registered queries: vector search, traversal, scoring, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.vectors import cosine
from citeloom.operators import context as ctx
from citeloom.operators import ranking, traverse
from citeloom.operators.knn import vector_search
from citeloom.operators.retrieve import (
    Retrieved, baseline, graph_context, retrieval_stats, retrieve, with_properties,
)
from citeloom.operators.seeds import resolve_seeds, seed_papers
from citeloom.plans import domain as d
from citeloom.plans.domain_sql import tok, using
from citeloom.plans.registry import ORACLES, query
from citeloom.runtime import scratch_folder, written

# What the limited requests name; operators have no limits of their own.
ROWS, NODES = 2000, 200

_FOUND: dict[tuple[str, str], Retrieved] = {}


def found(spark, sf) -> Retrieved:
    """The scoped question batch, retrieved once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOUND:
        _FOUND[key] = retrieve(d.corpus(spark, sf), questions(spark, sf), row_limit=ROWS, max_nodes=NODES)
    return _FOUND[key]


_ASKED: dict[tuple[str, str], object] = {}


def questions(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ASKED:
        _ASKED[key] = written(d.questions(spark, sf, scoped=True), "questions")
    return _ASKED[key]


@query("v3_cosine_search", using("scores") + """
    SELECT query_id, vec_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scores QUALIFY rank <= 10""")
def cosine_search(spark, sf):
    corpus = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector_search(corpus, questions(spark, sf).select("query_id", "vector"), 10, d.DIMENSION)


@query("v3_cosine_search_filtered", using("scores") + """
    SELECT query_id, vec_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scores JOIN embeddings USING (vec_id) WHERE label = (query_id + 1) % 10 QUALIFY rank <= 10""")
def cosine_search_filtered(spark, sf):
    corpus = d.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("scope"))
    asked = questions(spark, sf).select(
        "query_id", "vector", ((F.col("query_id") + 1) % 10).cast("string").alias("scope"))
    return vector_search(corpus, asked, 10, d.DIMENSION)


@query("v4_entity_seeds", using("entity_seeds") + "SELECT query_id, node_id, score, rank FROM entity_seeds")
def entity_seed_rows(spark, sf):
    return found(spark, sf).entity_seeds.select("query_id", "node_id", "score", "rank")


@query("v5_chunk_seeds", using("chunk_seeds") + """
    SELECT query_id, chunk_id, paper_id, section_name, score, rank FROM chunk_seeds""")
def chunk_seed_rows(spark, sf):
    return found(spark, sf).chunk_seeds.select("query_id", "chunk_id", "paper_id", "section_name", "score", "rank")


@query("v6_seed_papers", using("seed_papers") + "SELECT query_id, paper_id FROM seed_papers")
def seed_paper_rows(spark, sf):
    hit = found(spark, sf)
    return seed_papers(hit.entity_seeds, hit.chunk_seeds, d.corpus(spark, sf).entity_papers)


@query("v7_baseline_sources", using("chunk_seeds") + """
    SELECT query_id, rank, paper_id, 'Order ' || paper_id AS paper_title, section_name, score FROM chunk_seeds""")
def baseline_sources(spark, sf):
    return baseline(d.corpus(spark, sf), questions(spark, sf)).select(
        "query_id", "rank", "paper_id", "paper_title", "section_name", "score")


@query("v8_centroid_cosine", using("questions") + """
    SELECT vec_id, round(list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])), 9) + 0.0 AS cosine
    FROM embeddings JOIN questions ON query_id = label""")
def centroid_cosine(spark, sf):
    own = questions(spark, sf).select(F.col("query_id").alias("label"), "vector")
    return d.table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("long")).join(own, "label").select(
        "vec_id", (F.round(cosine(F.col("vector"), F.col("embedding")), 9) + 0.0).alias("cosine"))


@query("v9_best_chunk_per_paper", using("best_chunk") + "SELECT query_id, paper_id, chunk_score FROM best_chunk")
def best_chunk(spark, sf):
    return ranking.best_chunk_score(found(spark, sf).chunk_seeds)


@query("p7_resolved_seeds", using("seeds") + "SELECT query_id, node_id FROM seeds")
def resolved_seeds(spark, sf):
    hit, corpus = found(spark, sf), d.corpus(spark, sf)
    papers = seed_papers(hit.entity_seeds, hit.chunk_seeds, corpus.entity_papers)
    return resolve_seeds(hit.entity_seeds, papers, corpus.nodes, questions(spark, sf))


@query("g1_traversal", using("traversed") + "SELECT query_id, src, dst, rel_type, conf, ord FROM traversed")
def traversal(spark, sf):
    return traverse.traverse(d.corpus(spark, sf).edges, found(spark, sf).seeds, row_limit=ROWS)


@query("g1_three_hops_by_type", using("seeds", "ends") + """
    , typed AS (SELECT * FROM ends WHERE rel_type IN ('AUTHORED_BY', 'REPORTS_RESULT')),
    r1 AS (SELECT query_id, node_id FROM seeds UNION SELECT query_id, other FROM seeds JOIN typed USING (node_id)),
    r2 AS (SELECT query_id, node_id FROM r1 UNION SELECT query_id, other FROM r1 JOIN typed USING (node_id))
    SELECT query_id, src, dst, rel_type, coalesce(confidence, 0) AS conf,
           row_number() OVER (PARTITION BY query_id ORDER BY coalesce(confidence, 0) DESC, src, dst, rel_type) AS ord
    FROM (SELECT DISTINCT query_id, src, dst, rel_type, confidence FROM r2 JOIN typed USING (node_id)) QUALIFY ord <= 2000""")
def three_hops(spark, sf):
    return traverse.traverse(
        d.corpus(spark, sf).edges, found(spark, sf).seeds, hops=3, rel_types=["AUTHORED_BY", "REPORTS_RESULT", "UNKNOWN"], row_limit=ROWS)


@query("g1_traversal_whole", using("reached") + """
    SELECT query_id, src, dst, rel_type, coalesce(confidence, 0) AS conf,
           row_number() OVER (PARTITION BY query_id ORDER BY coalesce(confidence, 0) DESC, src, dst, rel_type) AS ord
    FROM (SELECT DISTINCT query_id, src, dst, rel_type, confidence FROM reached JOIN ends USING (node_id))""")
def traversal_whole(spark, sf):
    return traverse.traverse(d.corpus(spark, sf).edges, found(spark, sf).seeds)


@query("g1_stored_adjacency", ORACLES["g1_traversal_whole"])
def stored_adjacency(spark, sf):
    links = traverse.store_two_way(d.corpus(spark, sf).edges, "citeloom_links", scratch_folder(spark, "links"), buckets=8)
    return traverse.traverse(d.corpus(spark, sf).edges, found(spark, sf).seeds, links=links)


@query("g4_distances_whole", using("reached") + """
    , own AS (SELECT DISTINCT query_id, src, dst FROM reached JOIN ends USING (node_id)),
    met AS (SELECT DISTINCT query_id, unnest([src, dst]) AS node_id FROM own),
    zero AS (SELECT query_id, node_id FROM met SEMI JOIN seeds USING (query_id, node_id)),
    one AS (SELECT DISTINCT o.query_id, CASE WHEN o.src = z.node_id THEN o.dst ELSE o.src END AS node_id
            FROM own o JOIN zero z ON z.query_id = o.query_id AND z.node_id IN (o.src, o.dst))
    SELECT query_id, node_id, CASE WHEN z.node_id IS NOT NULL THEN 0 WHEN n.node_id IS NOT NULL THEN 1 ELSE 2 END AS distance
    FROM met LEFT JOIN zero z USING (query_id, node_id) LEFT JOIN one n USING (query_id, node_id)""")
def distances_whole(spark, sf):
    seeds = found(spark, sf).seeds
    return traverse.seed_distances(traverse.traverse(d.corpus(spark, sf).edges, seeds), seeds)


@query("g2_subgraph_nodes", using("met") + "SELECT query_id, node_id, node_ord FROM met")
def subgraph_nodes(spark, sf):
    return traverse.subgraph_nodes(traverse.traverse(d.corpus(spark, sf).edges, found(spark, sf).seeds, row_limit=ROWS))


@query("p4_entity_type_filter", using("traversed", "nodes") + """
    , ok AS (SELECT query_id, node_id FROM seeds UNION
             SELECT query_id, node_id FROM met WHERE label IN ('Method', 'Claim'))
    SELECT t.query_id, src, dst, rel_type, conf, ord FROM traversed t
    JOIN ok a ON a.query_id = t.query_id AND a.node_id = src JOIN ok b ON b.query_id = t.query_id AND b.node_id = dst
    """.replace(", ok AS", ", met AS (SELECT query_id, node_id, label FROM (SELECT query_id, src AS node_id FROM traversed UNION SELECT query_id, dst FROM traversed) JOIN nodes USING (node_id)), ok AS"))
def entity_type_filter(spark, sf):
    corpus, seeds = d.corpus(spark, sf), found(spark, sf).seeds
    return traverse.filter_entity_types(
        traverse.traverse(corpus.edges, seeds, row_limit=ROWS), corpus.nodes, seeds, ["Method", "Claim"])


@query("p5_relation_type_filter", using("edges") + """
    SELECT rel_type, count(*) AS n, sum(occurrence_count)::BIGINT AS writes FROM edges
    WHERE rel_type IN ('EVALUATES_ON', 'INTRODUCES') GROUP BY rel_type""")
def relation_type_filter(spark, sf):
    kept = traverse.of_types(d.corpus(spark, sf).edges, ["INTRODUCES", "EVALUATES_ON", "CITES"])
    return kept.groupBy("rel_type").agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("writes"))


@query("p6_collection_scope", using("scoped_nodes") + "SELECT query_id, node_id FROM scoped_nodes")
def collection_scope(spark, sf):
    corpus = d.corpus(spark, sf)
    edges = traverse.traverse(corpus.edges, found(spark, sf).seeds, row_limit=ROWS)
    return traverse.scope_to_collection(edges, corpus.nodes, questions(spark, sf))[1].select("query_id", "node_id")


@query("g3_capped_nodes", using("capped_nodes") + "SELECT query_id, node_id, node_ord FROM capped_nodes")
def capped_nodes(spark, sf):
    return found(spark, sf).nodes.select("query_id", "node_id", "node_ord")


@query("g3_capped_edges", using("capped_edges") + "SELECT query_id, src, dst, rel_type, conf, ord FROM capped_edges")
def capped_edges(spark, sf):
    return found(spark, sf).edges.select("query_id", "src", "dst", "rel_type", "conf", "ord")


@query("g4_seed_distances", using("distances") + "SELECT query_id, node_id, distance FROM distances")
def seed_distances(spark, sf):
    hit = found(spark, sf)
    return traverse.seed_distances(hit.edges, hit.seeds, limited=True)


@query("g5_average_confidence", using("trust") + """
    SELECT query_id, node_id, round(avg_confidence, 9) AS avg_confidence FROM trust""")
def average_confidence(spark, sf):
    return ranking.average_confidence(found(spark, sf).edges).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("j7_node_similarity", using("scored") + "SELECT query_id, node_id, similarity FROM scored")
def node_similarity(spark, sf):
    hit = found(spark, sf)
    described = hit.nodes.join(d.corpus(spark, sf).nodes, "node_id")
    return ranking.similarity(described, hit.entity_seeds, hit.chunk_seeds).select("query_id", "node_id", "similarity")


@query("g6_hybrid_score", using("scored") + "SELECT query_id, node_id, distance, score FROM scored")
def hybrid_score(spark, sf):
    return found(spark, sf).scored.select("query_id", "node_id", "distance", "score")


@query("g7_ranked_nodes", using("ranked") + "SELECT query_id, rank, node_id, label, score FROM ranked")
def ranked_nodes(spark, sf):
    return found(spark, sf).ranked.select("query_id", "rank", "node_id", "label", "score")


@query("g8_ranked_edges", using("ranked_edges") + "SELECT query_id, src, dst, rel_type, conf FROM ranked_edges")
def ranked_edges(spark, sf):
    return found(spark, sf).ranked_edges.select("query_id", "src", "dst", "rel_type", "conf")


_LINES = using("ranked_edges", "edges") + f"""
    , intro AS (SELECT e.query_id, dst AS node_id, last(r.title ORDER BY ord) AS it, last(r.year ORDER BY ord) AS iy
                FROM ranked_edges e JOIN ranked r ON r.query_id = e.query_id AND r.node_id = e.src
                WHERE rel_type = 'INTRODUCES' GROUP BY e.query_id, dst),
    entity_lines AS (
        SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY
                 list_position(['Method', 'Dataset', 'Paper', 'Author', 'Metric', 'Claim'], label), rank) AS line_no,
               CASE label WHEN 'Method' THEN '- [METHOD] ' || name || coalesce(' (introduced by Paper: ''' || it || ''', ' || iy || ')', '')
                          WHEN 'Dataset' THEN '- [DATASET] ' || name
                          WHEN 'Paper' THEN '- [PAPER] ''' || title || ''' (' || year || ', ' || venue || ')'
                          WHEN 'Claim' THEN '- [CLAIM] ' || text ELSE '- [AUTHOR] ' || name END AS line
        FROM ranked r LEFT JOIN intro USING (query_id, node_id)),
    shown AS (SELECT query_id, node_id, CASE WHEN label = 'Paper' THEN '''' || title || '''' ELSE coalesce(name, text) END AS shown FROM ranked),
    relationship_lines AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS line_no, line
        FROM (SELECT r.query_id, r.ord, CASE r.rel_type
                WHEN 'EVALUATES_ON' THEN '- ' || a.shown || ' EVALUATES_ON ' || b.shown || ' (' || metric || ': ' || value || ')'
                WHEN 'REPORTS_RESULT' THEN '- ' || a.shown || ' REPORTS_RESULT: ' || b.shown
                WHEN 'USES_METHOD' THEN '- ' || a.shown || ' USES_METHOD ' || b.shown || ' (evidence: "' || evidence_text || '")' END AS line
              FROM ranked_edges r JOIN edges e ON e.src = r.src AND e.dst = r.dst AND e.rel_type = r.rel_type
              JOIN shown a ON a.query_id = r.query_id AND a.node_id = r.src
              JOIN shown b ON b.query_id = r.query_id AND b.node_id = r.dst)
        WHERE line IS NOT NULL)"""


@query("u8_entity_lines", _LINES + " SELECT query_id, line_no, line FROM entity_lines")
def entity_lines(spark, sf):
    hit = found(spark, sf)
    return ctx.entity_lines(hit.ranked, hit.ranked_edges)


@query("u9_relationship_lines", _LINES + " SELECT query_id, line_no, line FROM relationship_lines")
def relationship_lines(spark, sf):
    hit = found(spark, sf)
    return ctx.relationship_lines(hit.ranked, with_properties(hit.ranked_edges, d.corpus(spark, sf).edges))


@query("j8_introduced_by", using("ranked_edges") + """
    SELECT e.query_id, dst AS node_id, last(r.title ORDER BY ord) AS intro_title, last(r.year ORDER BY ord) AS intro_year
    FROM ranked_edges e JOIN ranked r ON r.query_id = e.query_id AND r.node_id = e.src
    WHERE rel_type = 'INTRODUCES' GROUP BY e.query_id, dst""")
def introduced_by(spark, sf):
    hit = found(spark, sf)
    return ctx.introduced_by(hit.ranked, hit.ranked_edges)


def _context_sql(budget: int, max_tokens: int) -> str:
    return _LINES + f"""
    , packed AS (SELECT query_id, 1 AS kind, line_no, line FROM entity_lines
         UNION ALL SELECT query_id, 2, line_no, line FROM relationship_lines
         UNION ALL SELECT query_id, 3, rank, '- [' || section_name || '] ' || text FROM chunk_seeds),
    counted AS (SELECT *, {tok('line')} AS n FROM packed),
    summed AS (SELECT *, sum(n) OVER (PARTITION BY query_id, kind ORDER BY line_no) AS upto,
                      sum(CASE WHEN kind = 1 THEN n ELSE 0 END) OVER (PARTITION BY query_id) AS ents FROM counted),
    first_fit AS (SELECT *, CASE kind WHEN 1 THEN upto <= {budget} WHEN 2 THEN ents + upto <= {budget} END AS ok FROM summed),
    heads AS (SELECT query_id, sum(n) FILTER (ok AND kind < 3) AS used,
                     coalesce(max(2) FILTER (ok AND kind = 1), 0) + coalesce(max(2) FILTER (ok AND kind = 2), 0) AS head
              FROM first_fit GROUP BY query_id),
    fit AS (SELECT f.query_id, kind, line_no, line, n, CASE WHEN kind = 3 THEN coalesce(used, 0) + head + 4 + upto <= {max_tokens} ELSE ok END AS ok
            FROM first_fit f JOIN heads USING (query_id)),
    blocks AS (SELECT query_id, kind, CASE kind WHEN 1 THEN 'ENTITIES:' WHEN 2 THEN 'RELATIONSHIPS:' ELSE 'RELEVANT TEXT CHUNKS:' END
                      || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS block FROM fit WHERE ok GROUP BY query_id, kind),
    built AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY kind) AS text FROM blocks GROUP BY query_id)
    SELECT q.query_id, coalesce(text, '') AS text, CAST({tok("coalesce(text, '')")} AS INTEGER) AS token_count,
           EXISTS (SELECT 1 FROM fit f WHERE f.query_id = q.query_id AND NOT ok) AS truncated
    FROM questions q LEFT JOIN built USING (query_id)"""


@query("u7_context", _context_sql(6500, 8000))
def context_text(spark, sf):
    return graph_context(d.corpus(spark, sf), questions(spark, sf), found(spark, sf))


@query("u7_context_tight", _context_sql(150, 1650))
def context_text_tight(spark, sf):
    return graph_context(d.corpus(spark, sf), questions(spark, sf), found(spark, sf), max_tokens=1650)


@query("u10_baseline_context", using("chunk_seeds") + f"""
    SELECT query_id, text, CAST({tok('text')} AS INTEGER) AS token_count FROM (
        SELECT query_id, string_agg('[' || rank || '] (paper_id=' || paper_id || ', section=' || section_name || ') ' || text,
                                    chr(10) || chr(10) ORDER BY rank) AS text FROM chunk_seeds GROUP BY query_id)""")
def baseline_context(spark, sf):
    return ctx.baseline_context(found(spark, sf).chunk_seeds)


@query("u13_citations", using("ranked") + """
    , shown AS (SELECT query_id, paper_id, title, year, rank AS o FROM ranked WHERE label = 'Paper'),
    extra AS (SELECT query_id, paper_id, min(rank) + 1000 AS o FROM chunk_seeds c WHERE NOT EXISTS (
        SELECT 1 FROM shown s WHERE s.query_id = c.query_id AND s.paper_id = c.paper_id) GROUP BY query_id, paper_id)
    SELECT query_id, paper_id, title, year, row_number() OVER (PARTITION BY query_id ORDER BY o) AS ord FROM (
        SELECT * FROM shown UNION ALL SELECT query_id, paper_id, 'Order ' || paper_id, NULL, o FROM extra)""")
def citation_rows(spark, sf):
    hit = found(spark, sf)
    return ctx.citations(hit.ranked, hit.chunk_seeds, d.corpus(spark, sf).papers)


@query("a11_retrieval_stats", using("ranked") + """
    SELECT query_id, (SELECT count(*) FROM entity_seeds e WHERE e.query_id = q.query_id) AS entity_seeds,
           (SELECT count(*) FROM chunk_seeds e WHERE e.query_id = q.query_id) AS chunk_seeds,
           (SELECT count(*) FROM capped_nodes e WHERE e.query_id = q.query_id) AS graph_nodes,
           (SELECT count(*) FROM ranked e WHERE e.query_id = q.query_id) AS ranked_nodes FROM questions q""")
def stats(spark, sf):
    hit, asked = found(spark, sf), questions(spark, sf)
    context = graph_context(d.corpus(spark, sf), asked, hit)
    return retrieval_stats(asked, hit, context).drop("context_tokens", "context_truncated")
