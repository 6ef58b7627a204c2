"""Registered queries: merges, updates, deletes, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.text import norm_name
from citeloom.operators import merge
from citeloom.plans import domain as d
from citeloom.plans.domain_sql import LINE_ORDER, using
from citeloom.plans.registry import ORACLES, query
from citeloom.runtime import scratch_folder
from citeloom.sources.snapshots import Snapshots, Table


def _part_changes(spark, sf):
    """Part rows as writes to the node of their name; brand is passed for large sizes only, type as null for small ones."""
    p = d.table(spark, sf, "part")
    big, small = F.col("p_size") > 25, F.col("p_size") < 5
    return p.select(
        F.lit("Method").alias("label"), F.col("p_name").alias("key"), F.col("p_partkey").alias("seq"),
        F.when(small, F.lit(None)).otherwise(F.col("p_type")).alias("category"), F.col("p_brand").alias("description"),
        F.when(big, F.array(F.lit("category"), F.lit("description"))).otherwise(F.array(F.lit("category"))).alias("passed"))


@query("k4_node_merge", """
    SELECT p_name AS key, CASE WHEN arg_max(p_size, p_partkey) >= 5 THEN arg_max(p_type, p_partkey) END AS category,
           arg_max(p_brand, p_partkey) FILTER (p_size > 25) AS description FROM part GROUP BY p_name""")
def node_merge(spark, sf):
    return merge.merge_nodes(_part_changes(spark, sf), ["label", "key"], ["category", "description"]).drop("label")


@query("k5_edge_merge", using("edges") + """
    SELECT src, dst, rel_type, confidence, evidence_text, occurrence_count FROM edges WHERE rel_type IN ('USES_METHOD', 'EVALUATES_ON')""")
def edge_merge(spark, sf):
    return merge.first_write(d.raw_relations(spark, sf), ["confidence", "evidence_text"])


@query("k5_edge_merge_into_stored", using("edges") + f"""
    , stored AS (SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, first('line ' || l_linenumber ORDER BY {LINE_ORDER}) AS evidence_text, count(*) AS n
                 FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
    SELECT e.src, e.dst, e.rel_type, coalesce(s.evidence_text, e.evidence_text) AS evidence_text, e.occurrence_count
    FROM edges e LEFT JOIN stored s USING (src, dst) WHERE rel_type = 'USES_METHOD'""")
def edge_merge_into_stored(spark, sf):
    li = d.table(spark, sf, "lineitem").select(
        d._id("o", "l_orderkey").alias("src"), d._id("p", "l_partkey").alias("dst"), F.lit("USES_METHOD").alias("rel_type"),
        d.line_order().alias("seq"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("evidence_text"), "l_linestatus")
    stored = merge.first_write(li.filter(F.col("l_linestatus") == "F"), ["evidence_text"])
    return merge.merge_edges(stored, li.filter(F.col("l_linestatus") != "F"), ["evidence_text"])


def _store(spark, buckets=16, **tables):
    """An empty store of the given tables: name = (a DataFrame of its columns, key)."""
    return Snapshots(spark, scratch_folder(spark, "store"), {n: Table(df.schema, tuple(key)) for n, (df, key) in tables.items()}, buckets)


@query("k5_merge_touched_buckets", ORACLES["k5_edge_merge_into_stored"])
def merge_touched_buckets(spark, sf):
    """The same merge, as two commits to a stored table of which the second rewrites only the buckets it falls into."""
    li = d.table(spark, sf, "lineitem").select(
        d._id("o", "l_orderkey").alias("src"), d._id("p", "l_partkey").alias("dst"), F.lit("USES_METHOD").alias("rel_type"),
        d.line_order().alias("seq"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("evidence_text"), "l_linestatus")
    store = _store(spark, edges=(merge.first_write(li, ["evidence_text"]), merge.EDGE_KEY))
    for part in (F.col("l_linestatus") == "F", F.col("l_linestatus") != "F"):
        store.begin().merge("edges", li.filter(part), lambda old, new: merge.merge_edges(old, new, ["evidence_text"])).commit()
    return store.read("edges")


@query("k1_atomic_batches", """
    SELECT 'o:' || o_orderkey AS node_id, o_orderpriority AS collection_id, coalesce(edges, 0) AS edges, coalesce(writes, 0) AS writes, 2 AS version
    FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS edges, count(*) AS writes FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    WHERE o_orderkey % 3 <> 1""")
def atomic_batches(spark, sf):
    """Orders and their lines in three batches: the second stages its nodes and is given up, the others are committed."""
    nodes = d.table(spark, sf, "orders").select(d._id("o", "o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("collection_id"), (F.col("o_orderkey") % 3).alias("batch"))
    li = d.table(spark, sf, "lineitem").select(
        d._id("o", "l_orderkey").alias("src"), d._id("p", "l_partkey").alias("dst"), F.lit("USES_METHOD").alias("rel_type"), d.line_order().alias("seq"),
        F.col("l_linenumber").alias("line"), (F.col("l_orderkey") % 3).alias("batch"))
    store = _store(spark, nodes=(nodes.drop("batch"), ["node_id"]), edges=(merge.first_write(li, ["line"]), merge.EDGE_KEY))
    for batch in range(3):
        change = store.begin().upsert("nodes", nodes.filter(F.col("batch") == batch))
        if batch == 1:
            change.abort()
            continue
        change.merge("edges", li.filter(F.col("batch") == batch), lambda old, new: merge.merge_edges(old, new, ["line"])).commit()
    sums = store.read("edges").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("edges"), F.sum("occurrence_count").alias("writes"))
    return store.read("nodes").join(sums, "node_id", "left").na.fill(0, ["edges", "writes"]).withColumn("version", F.lit(store.version()))


@query("k6_paper_nodes", """
    SELECT CAST(conv_id AS VARCHAR) AS paper_id, arg_max(role, turn) AS title, arg_max(nullif(text, ''), turn) IS NOT NULL AS has_text, CAST(max(turn) AS INTEGER) AS year
    FROM conversations GROUP BY conv_id""")
def paper_nodes(spark, sf):
    none = F.lit(None).cast("string")
    papers = d.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("paper_id"), F.col("role").alias("title"), F.array("role").alias("authors"),
        F.col("turn").cast("int").alias("year"), none.alias("venue"), F.col("text").alias("abstract"), none.alias("collection_id"), "turn")
    changes = merge.paper_changes(papers, F.col("turn"))
    kept = merge.merge_nodes(changes.withColumn("passed", F.array_union("passed", F.array(F.lit("embed_text")))),
                             ["paper_id"], ["title", "embed_text", "year"])
    return kept.select("paper_id", "title", F.col("embed_text").isNotNull().alias("has_text"), "year")


@query("k7_author_edges", """
    SELECT CAST(o_custkey % 1000 AS VARCHAR) AS paper_id, trim(c_name) AS author, count(*) AS occurrence_count
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def author_edges(spark, sf):
    o = d.table(spark, sf, "orders").join(d.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    papers = o.select(F.pmod("o_custkey", F.lit(1000)).cast("string").alias("paper_id"), F.array(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("authors"))
    written = merge.author_edges(papers).select(
        F.col("paper_id").alias("src"), F.col("author").alias("dst"), F.lit("AUTHORED_BY").alias("rel_type"), "seq", F.lit(1).alias("one"))
    return merge.first_write(written, ["one"]).select(F.col("src").alias("paper_id"), F.col("dst").alias("author"), "occurrence_count")


@query("k9_claim_nodes", """
    SELECT claim_id, arg_max(text, turn) AS text, arg_max(role, turn) AS claim_type FROM (
        SELECT *, substr(sha256(conv_id || ':' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 24) AS claim_id FROM conversations)
    GROUP BY claim_id""")
def claim_nodes(spark, sf):
    claims = d.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("paper_id"), "text", F.col("role").alias("claim_type"), F.lit(0.9).alias("confidence"), "turn")
    return merge.claim_nodes(claims, F.col("turn")).select("claim_id", "text", "claim_type")


@query("k10_entity_provenance", """
    SELECT 'p:' || l_partkey AS node_id, count(DISTINCT l_orderkey) AS papers, any_value(p_name || CASE WHEN p_size > 10 THEN ': ' || p_brand ELSE '' END) AS document
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey""")
def entity_provenance(spark, sf):
    li = d.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").cast("string").alias("paper_id"), d.line_order().alias("seq"))
    p = d.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("canonical_name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("description"))
    mentions = li.join(p, "p_partkey").select(d._id("p", "p_partkey").alias("node_id"), F.lit("Method").alias("entity_type"), "canonical_name",
                                              "description", F.lit(None).cast("array<float>").alias("vector"), "paper_id", "seq")
    rows, pairs = merge.entity_vector_rows(mentions)
    return rows.join(pairs.groupBy("node_id").agg(F.count("*").alias("papers")), "node_id").select("node_id", "papers", "document")


@query("k12_vector_upsert", """
    SELECT doc_id, lang, source FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'q' || quality END AS lang, source FROM documents d LEFT JOIN labels l USING (doc_id))""")
def vector_upsert(spark, sf):
    stored = d.table(spark, sf, "documents").select("doc_id", "lang", "source")
    incoming = d.table(spark, sf, "labels").join(stored.select("doc_id", "source"), "doc_id").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"), "source")
    return merge.upsert(stored, incoming, ["doc_id"])


@query("k12_k14_stored_vectors", """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'q' || quality END AS lang, source
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0""")
def stored_vectors(spark, sf):
    """Upserts and deletes as commits to a stored table."""
    docs, labels = d.table(spark, sf, "documents").select("doc_id", "lang", "source"), d.table(spark, sf, "labels")
    store = _store(spark, vectors=(docs, ["doc_id"]))
    store.begin().upsert("vectors", docs).commit()
    labelled = labels.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"), "source")
    store.begin().upsert("vectors", labelled).delete("vectors", labels.filter("toxic = 1")).commit()
    return store.read("vectors")


@query("k13_payload_patch", """
    SELECT doc_id, lang AS a, CASE WHEN l.doc_id IS NULL THEN source ELSE 'toxic' || toxic END AS b, CAST(quality AS VARCHAR) AS c
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def payload_patch(spark, sf):
    def payload(*pairs):
        return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]).alias("payload")

    stored = d.table(spark, sf, "documents").select("doc_id", payload(("a", F.col("lang")), ("b", F.col("source"))))
    changes = d.table(spark, sf, "labels").select("doc_id", payload(
        ("b", F.concat(F.lit("toxic"), F.col("toxic").cast("string"))), ("c", F.col("quality").cast("string"))))
    return merge.patch_payload(stored, changes, "doc_id").select(
        "doc_id", *[F.try_element_at("payload", F.lit(k)).alias(k) for k in "abc"])


@query("k14_delete_by_id", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_id(spark, sf):
    doomed = d.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return merge.delete_by(d.table(spark, sf, "documents").select("doc_id"), doomed, ["doc_id"])


@query("k2_patch", """
    SELECT doc_id, CASE WHEN quality = 0 THEN NULL WHEN quality = 1 THEN 'good' ELSE source END AS collection_id, lang FROM documents LEFT JOIN labels USING (doc_id)""")
def patch(spark, sf):
    stored = d.table(spark, sf, "documents").select("doc_id", F.col("source").alias("collection_id"), "lang")
    changes = d.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").alias("collection_id"), F.lit("ignored").alias("lang"), F.array(F.lit("collection_id")).alias("sent"))
    return merge.patch(stored, changes, "doc_id", ["collection_id", "lang"])


@query("k3_drop_collection", """
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN source <> (SELECT max(source) FROM documents) THEN source END AS collection_id FROM documents""")
def drop_collection(spark, sf):
    papers = d.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("collection_id"))
    collections = papers.select("collection_id").distinct()
    return merge.drop_collection(collections, papers, papers.agg(F.max("collection_id").alias("collection_id")))[1].select("paper_id", "collection_id")


@query("k1_j13_insert_new", """
    SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark) GROUP BY text""")
def insert_new(spark, sf):
    uploads = d.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    first = merge.first_arrivals(uploads, F.col("doc_id")).filter("not duplicate").select("doc_id", "content_hash")
    stored = d.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("content_hash"))
    return merge.insert_new(stored, first, ["content_hash"])


_GONE = using("nodes", "edges") + """
    , doomed AS (SELECT node_id, paper_id FROM nodes WHERE venue = 'F'),
    remaining AS (SELECT * FROM edges WHERE src NOT IN (SELECT node_id FROM doomed)),
    orphans AS (SELECT DISTINCT dst AS node_id FROM edges WHERE src IN (SELECT node_id FROM doomed) AND dst NOT IN (SELECT dst FROM remaining))"""


def _deleted(spark, sf):
    corpus = d.corpus(spark, sf)
    doomed = d.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("string").alias("paper_id"))
    return merge.delete_papers(corpus.papers, corpus.nodes, corpus.edges, corpus.chunk_vectors, corpus.entity_vectors, corpus.entity_papers, doomed)


@query("k15_delete_cascade_nodes", _GONE + """
    SELECT node_id, label FROM nodes WHERE node_id NOT IN (SELECT node_id FROM doomed) AND node_id NOT IN (SELECT node_id FROM orphans)""")
def cascade_nodes(spark, sf):
    return _deleted(spark, sf)["nodes"].select("node_id", "label")


@query("k15_delete_cascade_edges", _GONE + " SELECT src, dst, rel_type FROM remaining")
def cascade_edges(spark, sf):
    return _deleted(spark, sf)["edges"].select("src", "dst", "rel_type")


@query("k15_delete_cascade_provenance", _GONE + """
    SELECT DISTINCT 'p:' || l_partkey AS node_id, CAST(l_orderkey AS VARCHAR) AS paper_id FROM lineitem
    WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT paper_id FROM doomed) AND 'p:' || l_partkey NOT IN (SELECT node_id FROM orphans)""")
def cascade_provenance(spark, sf):
    return _deleted(spark, sf)["entity_papers"]


@query("k15_delete_cascade_chunks", _GONE + """
    SELECT vec_id AS chunk_id FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT paper_id FROM doomed)""")
def cascade_chunks(spark, sf):
    return _deleted(spark, sf)["chunks"].select("chunk_id")


def _copies(spark, sf):
    return d.table(spark, sf, "lineitem").select(
        d._id("o", "l_orderkey").alias("src"), d._id("s", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("rel_type"),
        F.col("l_linenumber").cast("long").alias("occurrence_count"), d.line_order().alias("seq"))


@query("k17_collapse_duplicates", """
    SELECT 'o:' || l_orderkey AS src, 's:' || l_suppkey AS dst, l_returnflag AS rel_type, max(l_linenumber) + count(*) - 1 AS occurrence_count
    FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag""")
def collapse_duplicates(spark, sf):
    return merge.collapse_duplicate_edges(_copies(spark, sf), [F.col("seq")]).drop("seq")


@query("k18_duplicate_preview", """
    SELECT l_returnflag AS rel_type, count(*) AS duplicate_groups, CAST(sum(c - 1) AS BIGINT) AS extra_edges FROM (
        SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag HAVING count(*) > 1) GROUP BY l_returnflag""")
def duplicate_preview(spark, sf):
    return merge.duplicate_edge_preview(_copies(spark, sf))


@query("k19_relabel", """
    SELECT doc_id, CASE WHEN source IN ('src1', 'src2') AND lang IN (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 2) THEN 'core'
           WHEN source IN ('src1', 'src2') THEN NULL ELSE source END AS collection_id FROM documents""")
def relabel(spark, sf):
    docs = d.table(spark, sf, "documents")
    stored = docs.select("doc_id", F.col("lang").alias("title"),
                         F.when(~F.col("source").isin("src1", "src2"), F.col("source")).alias("collection_id"))
    common = docs.groupBy(F.col("lang").alias("title")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(2)
    return merge.relabel(stored, common, F.lit("core")).select("doc_id", "collection_id")


@query("k20_graph_copy", using("nodes", "edges") + """
    SELECT 'n' || src AS src, 'n' || dst AS dst, rel_type FROM edges""")
def graph_copy(spark, sf):
    corpus = d.corpus(spark, sf)
    id_map = corpus.nodes.select(F.col("node_id").alias("old_id"), F.concat(F.lit("n"), "node_id").alias("new_id"))
    return merge.remap_graph(corpus.nodes, corpus.edges.select("src", "dst", "rel_type"), id_map)[1]


@query("k21_copy_counts", """
    SELECT source, count(*) AS source_rows, count(*) FILTER (lang = 'en') AS target_rows FROM documents GROUP BY source HAVING count(*) <> count(*) FILTER (lang = 'en')""")
def copy_counts(spark, sf):
    docs = d.table(spark, sf, "documents")
    return merge.count_mismatches(docs, docs.filter("lang = 'en'"), "source")


@query("k22_copy_rows", """
    SELECT doc_id, lang, 'source' AS side FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, upper(lang), 'target' FROM documents WHERE lang = 'de'""")
def copy_rows(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", "lang")
    return merge.row_mismatches(docs, docs.withColumn("lang", F.when(F.col("lang") == "de", "DE").otherwise(F.col("lang"))))


@query("a13_alias_sets", """
    SELECT lower(p_brand) AS entity, min(p_name) AS first_alias, count(DISTINCT p_name) AS aliases FROM part GROUP BY p_brand""")
def alias_sets(spark, sf):
    rows = d.table(spark, sf, "part").select(norm_name(F.col("p_brand")).alias("entity"), F.col("p_name").alias("alias")).distinct()
    return rows.groupBy("entity").agg(F.min("alias").alias("first_alias"), F.count("*").alias("aliases"))
