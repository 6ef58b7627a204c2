"""SQL statements of the domain rules, for the oracle side.

``using("edges", ...)`` gives the WITH clause of the named views and of all
they rest on, in order.
"""

from __future__ import annotations

TOKEN = r"\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
CONF = "round(1 - 5 * l_discount, 2)"


def tok(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{TOKEN}'))"


VIEWS: dict[str, tuple[list[str], str]] = {
    "claims": ([], f"""
        SELECT claim_id, first(paper_id ORDER BY {LINE_ORDER}) AS paper_id,
               first(text ORDER BY {LINE_ORDER}) AS text,
               first(confidence ORDER BY {LINE_ORDER}) AS confidence, count(*) AS n
        FROM (SELECT *, substr(sha256(paper_id || ':' || lower(text)), 1, 24) AS claim_id
              FROM (SELECT *, CAST(l_orderkey AS VARCHAR) AS paper_id, {CONF} AS confidence,
                           'Part ' || l_partkey || ' was returned in quantity ' || CAST(l_quantity AS BIGINT) AS text
                    FROM lineitem WHERE l_returnflag = 'R'))
        GROUP BY claim_id"""),
    "nodes": (["claims"], """
        SELECT 'o:' || o_orderkey AS node_id, 'Paper' AS label, CAST(NULL AS VARCHAR) AS name,
               'Order ' || o_orderkey AS title, CAST(NULL AS VARCHAR) AS text, CAST(o_orderkey AS VARCHAR) AS paper_id,
               CAST(NULL AS VARCHAR) AS source_paper_id, o_orderpriority AS collection_id,
               CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS venue
        FROM orders
        UNION ALL SELECT 'p:' || p_partkey, 'Method', p_name || ' ' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
        UNION ALL SELECT 's:' || s_suppkey, 'Dataset', s_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
        UNION ALL SELECT 'c:' || c_custkey, 'Author', c_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
        UNION ALL SELECT 'k:' || claim_id, 'Claim', NULL, NULL, text, NULL, paper_id, NULL, NULL, NULL FROM claims"""),
    "edges": (["claims"], f"""
        SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, 'USES_METHOD' AS rel_type,
               first({CONF} ORDER BY {LINE_ORDER}) AS confidence,
               'line ' || first(l_linenumber ORDER BY {LINE_ORDER}) AS evidence_text,
               CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS VARCHAR) AS value, count(*) AS occurrence_count
        FROM lineitem GROUP BY l_orderkey, l_partkey
        UNION ALL
        SELECT 'o:' || l_orderkey, 's:' || l_suppkey, 'EVALUATES_ON', first({CONF} ORDER BY {LINE_ORDER}),
               'line ' || first(l_linenumber ORDER BY {LINE_ORDER}), 'quantity',
               CAST(CAST(first(l_quantity ORDER BY {LINE_ORDER}) AS BIGINT) AS VARCHAR), count(*)
        FROM lineitem GROUP BY l_orderkey, l_suppkey
        UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'AUTHORED_BY', NULL, NULL, NULL, NULL, 1 FROM orders
        UNION ALL SELECT 'o:' || min(l_orderkey), 'p:' || l_partkey, 'INTRODUCES', 0.95, NULL, NULL, NULL, 1
        FROM lineitem GROUP BY l_partkey
        UNION ALL SELECT 'o:' || paper_id, 'k:' || claim_id, 'REPORTS_RESULT', confidence, text, NULL, NULL, n FROM claims"""),
    "ends": (["edges"], """
        SELECT src AS node_id, dst AS other, * FROM edges
        UNION ALL SELECT dst, src, * FROM edges WHERE src <> dst"""),
    "questions": ([], """
        SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS vec,
               list_extract(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], label % 5 + 1) AS wanted
        FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x
              FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
              GROUP BY label, pos)
        GROUP BY label"""),
    "scores": (["questions"], """
        SELECT query_id, vec_id, wanted, round(list_cosine_similarity(vec, CAST(embedding AS DOUBLE[])), 9) + 0.0 AS score
        FROM questions, embeddings"""),
    "entity_seeds": (["scores"], """
        SELECT query_id, 'p:' || vec_id AS node_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'p:' || vec_id) AS rank
        FROM scores QUALIFY rank <= 5"""),
    "chunk_seeds": (["scores"], """
        SELECT query_id, vec_id AS chunk_id, CAST(vec_id AS VARCHAR) AS paper_id, lang AS section_name, text, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
        FROM scores JOIN orders ON o_orderkey = vec_id AND o_orderpriority = wanted
        JOIN documents ON doc_id = vec_id QUALIFY rank <= 10"""),
    "seed_papers": (["entity_seeds", "chunk_seeds"], """
        SELECT query_id, paper_id FROM chunk_seeds
        UNION SELECT query_id, CAST(l_orderkey AS VARCHAR) FROM entity_seeds JOIN lineitem ON node_id = 'p:' || l_partkey"""),
    "seeds": (["seed_papers", "nodes"], """
        SELECT query_id, node_id FROM entity_seeds
        UNION SELECT query_id, node_id FROM seed_papers JOIN questions USING (query_id)
        JOIN nodes ON label = 'Paper' AND nodes.paper_id = seed_papers.paper_id AND collection_id = wanted"""),
    "reached": (["seeds", "ends"], """
        SELECT query_id, node_id FROM seeds
        UNION SELECT query_id, other FROM seeds JOIN ends USING (node_id)"""),
    "traversed": (["reached"], """
        SELECT query_id, src, dst, rel_type, coalesce(confidence, 0) AS conf,
               row_number() OVER (PARTITION BY query_id ORDER BY coalesce(confidence, 0) DESC, src, dst, rel_type) AS ord
        FROM (SELECT DISTINCT query_id, src, dst, rel_type, confidence FROM reached JOIN ends USING (node_id))
        QUALIFY ord <= 2000"""),
    "met": (["traversed", "nodes"], """
        SELECT query_id, node_id, min(o) AS node_ord, any_value(label) AS label, any_value(collection_id) AS collection_id,
               any_value(paper_id) AS paper_id, any_value(source_paper_id) AS source_paper_id
        FROM (SELECT query_id, src AS node_id, 2 * ord AS o FROM traversed
              UNION ALL SELECT query_id, dst, 2 * ord + 1 FROM traversed) JOIN nodes USING (node_id)
        GROUP BY query_id, node_id"""),
    "doomed": (["met"], """
        SELECT query_id, node_id FROM met JOIN questions USING (query_id)
        WHERE (label = 'Paper' AND collection_id IS DISTINCT FROM wanted)
           OR (label = 'Claim' AND NOT EXISTS (SELECT 1 FROM met p WHERE p.query_id = met.query_id
               AND p.label = 'Paper' AND p.collection_id = wanted AND p.paper_id = met.source_paper_id))"""),
    "scoped_edges": (["doomed"], """
        SELECT * FROM traversed t
        WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.query_id = t.query_id AND d.node_id = t.src)
          AND NOT EXISTS (SELECT 1 FROM doomed d WHERE d.query_id = t.query_id AND d.node_id = t.dst)"""),
    "scoped_nodes": (["scoped_edges"], """
        SELECT m.query_id, m.node_id, m.label FROM met m
        WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.query_id = m.query_id AND d.node_id = m.node_id)
          AND (NOT EXISTS (SELECT 1 FROM doomed d WHERE d.query_id = m.query_id) OR m.label = 'Paper'
               OR EXISTS (SELECT 1 FROM scoped_edges e WHERE e.query_id = m.query_id AND m.node_id IN (e.src, e.dst)))"""),
    "numbered": (["scoped_nodes"], """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS pos FROM scoped_edges"""),
    "crowded": (["scoped_nodes"], """
        SELECT query_id FROM scoped_nodes GROUP BY query_id HAVING count(*) > 200"""),
    "walk": (["numbered", "crowded"], """
        SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS kept, false AS taken FROM crowded
        UNION ALL
        SELECT query_id, pos, CASE WHEN fits THEN list_concat(kept, fresh) ELSE kept END, fits
        FROM (SELECT *, len(fresh) = 0 OR len(kept) + len(fresh) <= 200 AS fits
              FROM (SELECT w.query_id, e.pos, kept,
                           list_concat(CASE WHEN list_contains(kept, src) THEN [] ELSE [src] END,
                                       CASE WHEN src = dst OR list_contains(kept, dst) THEN [] ELSE [dst] END) AS fresh
                    FROM walk w JOIN numbered e ON e.query_id = w.query_id AND e.pos = w.pos + 1))"""),
    "capped_edges": (["walk"], """
        SELECT n.* EXCLUDE (pos) FROM numbered n WHERE query_id NOT IN (SELECT query_id FROM crowded)
        UNION ALL SELECT n.* EXCLUDE (pos) FROM numbered n JOIN walk w ON w.query_id = n.query_id AND w.pos = n.pos WHERE taken"""),
    "capped_nodes": (["capped_edges"], """
        SELECT query_id, node_id, min(o) AS node_ord
        FROM (SELECT query_id, src AS node_id, 2 * ord AS o FROM capped_edges
              UNION ALL SELECT query_id, dst, 2 * ord + 1 FROM capped_edges
              UNION ALL SELECT query_id, node_id, node_ord FROM met JOIN scoped_nodes USING (query_id, node_id)
              WHERE query_id NOT IN (SELECT query_id FROM crowded))
        GROUP BY query_id, node_id"""),
    "steps": (["capped_nodes"], """
        SELECT DISTINCT query_id, node_id, 0 AS distance
        FROM capped_edges e JOIN seeds s USING (query_id) WHERE node_id IN (src, dst)
        UNION
        SELECT s.query_id, CASE WHEN s.node_id = src THEN dst ELSE src END, distance + 1
        FROM steps s JOIN capped_edges e ON e.query_id = s.query_id AND s.node_id IN (src, dst) WHERE distance < 200"""),
    "distances": (["steps"], "SELECT query_id, node_id, min(distance) AS distance FROM steps GROUP BY query_id, node_id"),
    "trust": (["capped_edges"], """
        SELECT query_id, node_id, avg(conf) AS avg_confidence
        FROM (SELECT query_id, src AS node_id, conf FROM capped_edges
              UNION ALL SELECT query_id, dst, conf FROM capped_edges WHERE src <> dst)
        GROUP BY query_id, node_id"""),
    "best_chunk": (["chunk_seeds"], """
        SELECT query_id, paper_id, greatest(max(score), 0) AS chunk_score FROM chunk_seeds GROUP BY query_id, paper_id"""),
    "scored": (["distances", "trust", "best_chunk"], """
        SELECT c.query_id, c.node_id, node_ord, n.label, n.name, n.title, n.text, n.paper_id, n.year, n.venue,
               coalesce(e.score, CASE WHEN n.label = 'Paper' THEN chunk_score END, 0) AS similarity, distance,
               coalesce(avg_confidence, 0) AS avg_confidence,
               round(0.4 * coalesce(e.score, CASE WHEN n.label = 'Paper' THEN chunk_score END, 0)
                     + 0.4 * CASE WHEN distance IS NULL THEN 0 ELSE 1.0 / greatest(distance, 1) END
                     + 0.2 * coalesce(avg_confidence, 0), 9) AS score
        FROM capped_nodes c JOIN nodes n USING (node_id)
        LEFT JOIN entity_seeds e ON e.query_id = c.query_id AND e.node_id = c.node_id
        LEFT JOIN best_chunk b ON b.query_id = c.query_id AND b.paper_id = n.paper_id
        LEFT JOIN distances d ON d.query_id = c.query_id AND d.node_id = c.node_id
        LEFT JOIN trust t ON t.query_id = c.query_id AND t.node_id = c.node_id"""),
    "ranked": (["scored"], """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
            CASE label WHEN 'Method' THEN 0 WHEN 'Paper' THEN 1 WHEN 'Dataset' THEN 2 ELSE 3 END, node_ord, node_id) AS rank
        FROM scored QUALIFY rank <= 20"""),
    "ranked_edges": (["ranked"], """
        SELECT e.* FROM capped_edges e JOIN ranked a ON a.query_id = e.query_id AND a.node_id = e.src
        JOIN ranked b ON b.query_id = e.query_id AND b.node_id = e.dst"""),
}


def using(*names: str) -> str:
    """WITH clause of the named views, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for below in VIEWS[name][0]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" if n not in ("walk", "steps") else f"{n} AS ({VIEWS[n][1]})"
             for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
