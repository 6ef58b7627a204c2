"""Registered queries: sources, extraction, linking, resolution, evaluation, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from citeloom.functions.layout import authors_of, title_of
from citeloom.functions.vectors import embed
from citeloom.operators import compare, evals, extract, link, resolve
from citeloom.operators.context import baseline_context
from citeloom.plans import domain as d
from citeloom.plans import retrieval as r
from citeloom.plans.domain_sql import using
from citeloom.plans.registry import query
from citeloom.plans.text import documents
from citeloom.runtime import scratch_folder, spread, written
from citeloom.functions.text import split_sentences
from citeloom.settings import DEFAULTS
from citeloom.sources import checkpoints, feeds, files
from citeloom.streaming import jobs


def _uploads(spark, sf):
    """Documents as uploaded files; those of one source lack the PDF mark."""
    docs = d.table(spark, sf, "documents")
    head = F.when(F.col("source") == "src3", F.lit("")).otherwise(F.lit("%PDF-1.7\n"))
    return docs.select(
        F.floor(F.col("doc_id") / 40).alias("batch_id"), F.col("doc_id").cast("string").alias("filename"),
        F.encode(F.concat(head, "text"), "UTF-8").alias("content"))


@query("s2_pdf_validation", """
    SELECT CAST(doc_id AS VARCHAR) AS filename, CASE WHEN source = 'src3' THEN 'not a valid PDF (missing %PDF- header)' END AS reason FROM documents""")
def pdf_validation(spark, sf):
    return _uploads(spark, sf).select("filename", files.rejection(F.col("content")).alias("reason"))


@query("s3_upload_status", """
    WITH u AS (SELECT doc_id, source, sha256(CASE WHEN source = 'src3' THEN '' ELSE '%PDF-1.7' || chr(10) END || text) AS h FROM documents),
    stored AS (SELECT sha256('%PDF-1.7' || chr(10) || text) AS h FROM documents WHERE lang = 'de')
    SELECT CAST(doc_id AS VARCHAR) AS filename, CASE WHEN source = 'src3' THEN 'rejected'
           WHEN h IN (SELECT h FROM stored) OR doc_id > (SELECT min(doc_id) FROM u v WHERE v.h = u.h AND source <> 'src3') THEN 'duplicate' ELSE 'queued' END AS status
    FROM u""")
def upload_status(spark, sf):
    stored = d.table(spark, sf, "documents").filter("lang = 'de'").select(
        F.sha2(F.concat(F.lit("%PDF-1.7\n"), "text"), 256).alias("content_hash")).distinct().withColumn("paper_id", F.col("content_hash"))
    return files.upload(_uploads(spark, sf), stored, F.col("filename").cast("long")).select("filename", "status")


@query("s1_parsed_files", """
    SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN source <> 'src3' THEN len(string_split(text, chr(10))) END AS n_pages, source = 'src3' AS failed FROM documents""")
def parsed_files(spark, sf):
    """A plain-text stand-in for the PDF parser: one page per line, other files fail."""
    def plain(content: bytes) -> dict:
        head, _, text = content.decode("utf-8").partition("\n")
        if not head.startswith("%PDF-"):
            raise ValueError("no header")
        return {"full_text": text, "pages": text.split("\n")}

    parsed = files.parse(_uploads(spark, sf).withColumnRenamed("filename", "path"), plain)
    return parsed.select("path", F.when(F.col("error").isNull(), F.size("pages")).cast("long").alias("n_pages"), F.col("error").isNotNull().alias("failed"))


_TAGS = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""


@query("s1_html_papers", rf"""
    SELECT CAST(page_id AS VARCHAR) AS paper_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
           md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({_TAGS},
               '(?i)</?(p|br|h[1-6]|li|div|article|nav|ul|title)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
               '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest
    FROM pages""")
def html_papers(spark, sf):
    return files.html_papers(d.table(spark, sf, "pages")).select("paper_id", "title", F.md5("text").alias("digest"))


@query("s4_atom_metadata", """
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'Order ' || o_orderkey END AS title, CASE WHEN o_orderstatus <> 'P' THEN c_name END AS author,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders JOIN customer ON c_custkey = o_custkey""")
def atom_metadata(spark, sf):
    o = d.table(spark, sf, "orders").join(d.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ident = F.when(F.col("o_orderstatus") == "P", "http://arxiv.example/api/errors#x").otherwise("http://arxiv.example/abs/1")
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>'), ident, F.lit("</id><title>Order\n  "), F.col("o_orderkey").cast("string"),
        F.lit("</title><author><name> "), "c_name", F.lit("</name></author><published>"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("</published></entry></feed>"))
    return o.select("o_orderkey", feeds.atom_metadata(xml).alias("m")).select(
        "o_orderkey", "m.title", F.get("m.authors", F.lit(0)).alias("author"), "m.year")


@query("f9_title_and_authors")
def title_and_authors(spark, sf):
    """Document lines as layout: the first line in the largest font, the rest as byline and body."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    layout = F.transform(lines, lambda x, i: F.struct(F.when(i == 0, F.lit(20.0)).otherwise(F.lit(11.0)).alias("size"), x.alias("text")))
    rows = d.table(spark, sf, "documents").select("doc_id", layout.alias("layout"))
    return rows.select("doc_id", title_of(F.col("layout")).alias("title"), F.array_join(authors_of(F.col("layout")), "; ").alias("authors"))


def offline_entities():
    """Deterministic stand-in for a model: first word as method, an invented one, last word in doubt, first line as claim."""
    def complete(system: str, prompt: str) -> str:
        text = prompt.split("\n\n", 1)[1]
        words = text.split()
        reply = {"methods": [{"name": words[0], "category": "model", "confidence": 0.9}, {"name": "Zzyzx-9", "confidence": 1},
                             "not an object"],
                 "datasets": [{"name": words[-1], "domain": "text", "confidence": 0.3}],
                 "metrics": [{"name": "words", "value": len(words), "confidence": 7}],
                 "claims": [{"text": text.split("\n")[0], "type": "result", "confidence": 0.8}, {"text": words[0], "type": "opinion", "confidence": 1}]}
        return "```json\n" + json.dumps(reply) + "\n```"

    return complete


def _extracted(spark, sf):
    sections = documents(spark, sf).select("paper_id", F.lit(0).alias("ord"), F.lit("full_text").alias("name"), "text")
    return extract.extract_entities(sections, [offline_entities])


@query("u1_entities", r"""
    WITH w AS (SELECT *, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS words FROM documents WHERE trim(text) <> '')
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'method' AS kind, words[1] AS name, 0.9::DOUBLE AS confidence FROM w
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'metric', 'words', 1.0::DOUBLE FROM w
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'claim', trim(split_part(text, chr(10), 1)), 0.8::DOUBLE FROM w WHERE trim(split_part(text, chr(10), 1)) <> ''""")
def entities(spark, sf):
    return _extracted(spark, sf).select("paper_id", "kind", "name", "confidence")


@query("a6_entities_found", """
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, 2 + CAST(trim(split_part(text, chr(10), 1)) <> '' AS BIGINT) AS entities_found, CAST(0 AS BIGINT) AS relations_found
    FROM documents WHERE trim(text) <> ''""")
def entities_found(spark, sf):
    found = _extracted(spark, sf)
    return extract.entity_totals(found, found.filter("false"))


@query("u2_relations", r"""
    WITH w AS (SELECT *, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS words FROM documents WHERE trim(text) <> '')
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'USES_METHOD' AS relation_type, 'paper' AS source, words[1] AS target, CAST(len(words) AS VARCHAR) AS n_words FROM w""")
def relations(spark, sf):
    def offline():
        def complete(system, prompt):
            words = prompt.split("\n\n", 2)[2].split()
            return json.dumps({"relations": [
                {"type": "uses_method", "target": words[0], "evidence_text": "as stated", "confidence": "0.8", "n_words": len(words), "margin": None},
                {"type": "CITES", "target": "x", "confidence": 1}, {"type": "TRAINED_ON", "target": words[-1], "confidence": 0.2}]})
        return complete

    sections = documents(spark, sf).select("paper_id", F.lit(0).alias("ord"), F.lit("full_text").alias("name"), "text")
    none = sections.select("paper_id", "ord", F.array().cast("array<string>").alias("names"))
    return extract.extract_relations(sections, none, [offline]).select(
        "paper_id", "relation_type", "source", "target", F.try_element_at("properties", F.lit("n_words")).alias("n_words"))


@query("u5_claim_dedup")
def claim_dedup(spark, sf):
    """Sentences of each document as its claims."""
    claims = spread(d.table(spark, sf, "documents")).select(
        F.col("doc_id").alias("paper_id"), F.posexplode(split_sentences(F.col("text"))).alias("seq", "text"))
    return extract.dedupe_claims(claims.withColumn("vector", embed(F.col("text"), 64)))


@query("u5_claim_order", f"""
    WITH RECURSIVE claims AS (
        SELECT vec_id % 40 AS paper_id, vec_id AS seq, repeat('x', CAST(vec_id // 40 % 9 AS INTEGER)) || ':' || vec_id // 40 % 80 AS text,
               [CAST(x AS DOUBLE) FOR x IN embedding[1:3]] AS v FROM embeddings
        QUALIFY row_number() OVER (PARTITION BY vec_id % 40, vec_id // 40 % 9, vec_id // 40 % 80 ORDER BY vec_id) = 1),
    packed AS (SELECT paper_id, list(seq ORDER BY seq) AS seqs, list(length(text) ORDER BY seq) AS sizes, list(v ORDER BY seq) AS vs FROM claims GROUP BY paper_id),
    pass AS (
        SELECT paper_id, 0 AS j, CAST([] AS BIGINT[]) AS actors, CAST([] AS BIGINT[]) AS dead FROM packed
        UNION ALL
        SELECT paper_id, j, CASE WHEN stop IS NULL THEN list_append(actors, j) ELSE actors END,
               list_concat(dead, list_filter(near, lambda i: stop IS NULL OR i < stop))
        FROM (SELECT *, list_filter(near, lambda i: sizes[i] >= sizes[j])[1] AS stop
              FROM (SELECT s.paper_id, s.j + 1 AS j, s.actors, s.dead, p.sizes,
                           list_filter(s.actors, lambda i: round(list_cosine_similarity(p.vs[i], p.vs[s.j + 1]), 9) > {DEFAULTS.claim_duplicate_threshold}) AS near
                    FROM pass s JOIN packed p USING (paper_id) WHERE s.j < len(p.seqs)))),
    ended AS (SELECT p.seqs, s.actors, s.dead FROM pass s JOIN packed p USING (paper_id) WHERE s.j = len(p.seqs))
    SELECT seqs[i] AS seq FROM (SELECT seqs, dead, unnest(actors) AS i FROM ended) WHERE NOT list_contains(dead, i)""")
def claim_order(spark, sf):
    """Vectors as claims of 40 papers, near each other in three dimensions; some claims repeat."""
    turn = F.floor(F.col("vec_id") / 40)
    text = F.concat(F.repeat(F.lit("x"), (turn % 9).cast("int")), F.lit(":"), (turn % 80).cast("string"))
    claims = d.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 40).alias("paper_id"), F.col("vec_id").alias("seq"), text.alias("text"), F.slice("embedding", 1, 3).alias("vector"))
    return extract.dedupe_claims(claims).select("seq")


def _written_relations(spark, sf):
    """Lines as extracted relations; type by flag, some with a target of the wrong label."""
    li = d.table(spark, sf, "lineitem")
    p = d.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    kind = F.when(F.col("l_linenumber") == 6, "REPORTS_RESULT").when(F.col("l_returnflag") == "A", "USES_METHOD").when(
        F.col("l_returnflag") == "R", "TRAINED_ON").otherwise("EVALUATES_ON")
    target = F.when((F.col("l_linenumber") == 7) | (F.col("l_returnflag") == "A"), F.initcap("p_name")).otherwise(
        F.format_string(" supplier#%09d", "l_suppkey"))
    return li.join(p, "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("paper_id"), kind.alias("relation_type"), F.lit("paper").alias("source"),
        target.alias("target"), F.lit("").alias("evidence_text"), d.line_confidence().alias("confidence"), d.line_order().alias("seq"))


def _name_index(spark, sf):
    p = d.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("m:"), "p_name").alias("node_id"), F.lit("Method").alias("label"),
                                          F.col("p_partkey").alias("seq"))
    s = d.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), d._id("s", "s_suppkey").alias("node_id"), F.lit("Dataset").alias("label"),
                                              F.col("s_suppkey").alias("seq"))
    return link.name_index(p.unionByName(s), [])


def _own_names(spark, sf):
    """Names each order's own lines introduce, as its run would index them."""
    li = d.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey", "l_partkey", d.line_order().alias("seq"))
    p = d.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return link.name_index(li.join(p, "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("paper_id"), "name", F.concat(F.lit("m:"), "name").alias("node_id"), F.lit("Method").alias("label"), "seq"), ["paper_id"])


_LINKED = """
    WITH rels AS (SELECT l_orderkey, CASE WHEN l_linenumber = 6 THEN 'REPORTS_RESULT' WHEN l_returnflag = 'A' THEN 'USES_METHOD' WHEN l_returnflag = 'R' THEN 'TRAINED_ON' ELSE 'EVALUATES_ON' END AS rel_type,
                CASE WHEN l_linenumber = 7 OR l_returnflag = 'A' THEN 'm:' || p_name ELSE 's:' || l_suppkey END AS dst FROM lineitem JOIN part ON p_partkey = l_partkey),
    fitting AS (SELECT * FROM rels WHERE (rel_type = 'USES_METHOD' AND dst LIKE 'm:%') OR (rel_type IN ('TRAINED_ON', 'EVALUATES_ON') AND dst LIKE 's:%'))"""


@query("j6_p21_linked_relations", _LINKED + """
    SELECT 'o:' || l_orderkey AS src, dst, rel_type AS relation_type, count(*) AS n FROM fitting GROUP BY ALL""")
def linked_relations(spark, sf):
    own = _own_names(spark, sf)
    rows = link.fitting_targets(link.link(_written_relations(spark, sf), _name_index(spark, sf), own, F.concat(F.lit("o:"), "paper_id")))
    return rows.groupBy("src", "dst", "relation_type").agg(F.count("*").alias("n"))


@query("p23_without_conflicts", _LINKED + """
    SELECT 'o:' || l_orderkey AS src, dst, rel_type AS relation_type, count(*) AS n FROM fitting f
    WHERE rel_type <> 'TRAINED_ON' OR NOT EXISTS (SELECT 1 FROM fitting e WHERE e.rel_type = 'EVALUATES_ON' AND e.l_orderkey = f.l_orderkey AND e.dst = f.dst) GROUP BY ALL""")
def without_conflicts(spark, sf):
    own = _own_names(spark, sf)
    rows = link.linked_relations(_written_relations(spark, sf), _name_index(spark, sf), own, F.concat(F.lit("o:"), "paper_id"))
    return rows.groupBy("src", "dst", "relation_type").agg(F.count("*").alias("n"))


@query("p14_introduces_grounded", """
    SELECT p_partkey, true AS kept FROM part WHERE p_size % 2 = 0""")
def introduces_grounded(spark, sf):
    named = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("We call it "), F.initcap("p_name"), F.lit(" here."))).otherwise("12 %")
    rows = d.table(spark, sf, "part").select("p_partkey", F.lit("INTRODUCES").alias("relation_type"), F.initcap("p_name").alias("target"), named.alias("evidence_text"))
    return link.grounded_introductions(rows).select("p_partkey", F.lit(True).alias("kept"))


@query("p15_p16_offered_candidates", """
    SELECT p_brand AS paper_id, count(*) AS offered FROM (SELECT DISTINCT p_brand FROM part) AS part, (SELECT p_name FROM part) AS every
    WHERE p_name NOT IN (SELECT x.p_name FROM part x WHERE x.p_brand = part.p_brand) GROUP BY p_brand""")
def offered_candidates(spark, sf):
    offered = extract.foreign_candidates(*_named_parts(spark, sf))
    return offered.groupBy("paper_id").agg(F.sum(F.size("offered")).alias("offered"))


def _named_parts(spark, sf):
    """Parts as stored entities, and their names as what the paper of their brand names."""
    p = d.table(spark, sf, "part")
    existing = p.select(d._id("p", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.lit("Method").alias("entity_type"))
    return existing, p.select(F.col("p_brand").alias("paper_id"), F.col("p_name").alias("name"))


def relating_model():
    """A model that extends every third listed entity by the letters of its name, and one it was not offered."""
    def complete(system, prompt):
        listed = [line[2:].rpartition(" (")[0] for line in prompt.split("\n") if line.startswith("- ")]
        chosen = [name for name in dict.fromkeys(listed) if len(name) % 3 == 0] + ["nothing of the kind"]
        return json.dumps({"relations": [{"type": "EXTENDS", "source": "this", "target": name, "confidence": 0.9} for name in chosen]})

    return complete


@query("u3_relations_across_papers", """
    SELECT p_brand AS paper_id, count(DISTINCT p_name) AS related FROM (SELECT DISTINCT p_brand FROM part) AS part, (SELECT p_name FROM part) AS every
    WHERE length(p_name) % 3 = 0 AND p_name NOT IN (SELECT x.p_name FROM part x WHERE x.p_brand = part.p_brand) GROUP BY p_brand""")
def relations_across_papers(spark, sf):
    """Every brand as a paper of one section, asked about the names of all other brands."""
    existing, own = _named_parts(spark, sf)
    offered = written(extract.foreign_candidates(existing, own), "offered")
    sections = own.select("paper_id").distinct().select("paper_id", F.lit(0).alias("ord"), F.lit("method").alias("name"), F.col("paper_id").alias("text"))
    names = own.groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("names")).withColumn("ord", F.lit(0))
    found = extract.extract_relations(sections, names, [relating_model], across=True, candidates=offered, pause=0)
    return extract.known_targets(written(found, "across"), offered).groupBy("paper_id").agg(F.count_distinct("target").alias("related"))


@query("j9_close_names", f"""
    WITH keys AS (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS b, CAST(p_partkey % 7 AS INTEGER) AS d FROM part),
    changed AS (SELECT b, d, p_partkey % 4 < 2 AS swapped, CASE p_partkey % 4 WHEN 0 THEN repeat('z', d) || substr(b, d + 1)
                WHEN 1 THEN substr(b, 1, 16 - d) || repeat('z', d) || substr(b, 17) WHEN 2 THEN repeat('z', d) || b
                ELSE substr(b, 1, 16) || repeat('z', d) || substr(b, 17) END AS a FROM keys WHERE d > 0)
    SELECT a, b, round(CASE WHEN swapped THEN (32 - d) / CAST(32 AS DOUBLE) ELSE 64 / CAST(64 + d AS DOUBLE) END, 9) AS score FROM changed
    WHERE CASE WHEN swapped THEN (32 - d) / CAST(32 AS DOUBLE) ELSE 64 / CAST(64 + d AS DOUBLE) END > {DEFAULTS.fuzzy_threshold}""")
def close_names(spark, sf):
    """Digests of part keys against themselves with letters put in or in place of others, whose ratio is known."""
    keys = spread(d.table(spark, sf, "part").select("p_partkey")).select("p_partkey", F.md5(F.col("p_partkey").cast("string")).alias("b"), (F.col("p_partkey") % 7).cast("int").alias("d"))
    head, letters, tail = F.substring("b", 1, 16), F.repeat(F.lit("z"), F.col("d")), F.substring("b", 17, 16)
    shape = F.col("p_partkey") % 4
    changed = (
        F.when(shape == 0, F.concat(letters, F.substring(F.col("b"), F.col("d") + 1, F.lit(32))))
        .when(shape == 1, F.concat(F.substring(F.col("b"), F.lit(1), 16 - F.col("d")), letters, tail))
        .when(shape == 2, F.concat(letters, F.col("b"))).otherwise(F.concat(head, letters, tail))
    )
    method = F.lit("Method").alias("entity_type")
    new = keys.filter("d > 0").select(method, changed.alias("norm"), changed.alias("name"))
    known = keys.select(method, F.col("b").alias("norm"), F.col("b").alias("name"))
    return resolve.name_pairs(new, known).select("a", "b", F.round("score", 9).alias("score"))


@query("u4_exact_resolution", """
    SELECT lower(p_name) AS norm, count(*) AS mentions, min(p_partkey) AS seq FROM part GROUP BY 1""")
def exact_resolution(spark, sf):
    mentions = d.table(spark, sf, "part").select(F.initcap("p_name").alias("name"), F.lit("Method").alias("entity_type"), F.col("p_partkey").alias("seq"))
    return resolve.distinct_names(mentions).select("norm", "mentions", "seq")


@query("u4_entity_resolution")
def entity_resolution(spark, sf):
    """Part names with their brand as mentions against the plain names as stored entities."""
    p = d.table(spark, sf, "part")
    mentions = p.select(
        F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("-"), F.lower("p_type"))).when(F.col("p_size") > 30, F.concat("p_name", F.lit("s")))
        .when(F.col("p_size") > 20, F.concat("p_type", F.lit(" "), "p_brand")).otherwise(F.col("p_name")).alias("name"),
        F.lit("Method").alias("entity_type"), F.col("p_partkey").alias("seq"))
    stored = p.select(F.concat(F.lit("m:"), "p_name").alias("node_id"), F.lit("Method").alias("entity_type"), F.col("p_name").alias("name")).distinct()
    return resolve.resolve(mentions, stored).select("norm", "method", "node_key")


@query("u11_answers", using("chunk_seeds") + """
    SELECT q.query_id, CASE WHEN EXISTS (SELECT 1 FROM chunk_seeds c WHERE c.query_id = q.query_id) THEN 'label ' || q.query_id || '?'
           ELSE 'No relevant content was found.' END AS answer FROM questions q""")
def answers(spark, sf):
    def offline():
        return lambda system, prompt: prompt.split("<question>\n")[1].split("\n</question>")[0]

    context = baseline_context(r.found(spark, sf).chunk_seeds)
    asked = r.questions(spark, sf).select("query_id", F.concat(F.lit("label "), F.col("query_id").cast("string"), F.lit("?")).alias("question"))
    full = asked.join(context.select("query_id", "text"), "query_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return extract.answer(full, [offline], "Answer from the context only.", "No relevant content was found.").select("query_id", "answer")


@query("u12_faithfulness", """
    SELECT doc_id, quality = 0 AS warned FROM labels""")
def faithfulness(spark, sf):
    def offline():
        return lambda system, prompt: '{"score": ' + ("0.2" if prompt.endswith("quality 0") else "0.6") + "}"

    rows = d.table(spark, sf, "labels").select("doc_id", F.lit("some context").alias("text"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("answer"))
    return extract.faithfulness_warning(rows, [offline]).select("doc_id", F.col("warning").isNotNull().alias("warned"))


@query("u15_judge", """
    SELECT doc_id, CASE WHEN toxic = 1 THEN 0.0 ELSE CAST(quality AS DOUBLE) END AS score FROM labels""")
def judged(spark, sf):
    def offline():
        return lambda system, prompt: "no verdict" if prompt.endswith("toxic") else '{"score": ' + prompt[-1] + ".0}"

    rows = d.table(spark, sf, "labels").select(
        "doc_id", F.lit("q").alias("question"), F.lit("g").alias("gold_answer"),
        F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("quality").cast("string")).alias("answer"))
    return extract.judge(rows, [offline]).select("doc_id", "score")


@query("u14_k25_compare_log", """
    SELECT 'conversation ' || conv_id AS query_text, first(text ORDER BY turn) FILTER (role = 'user') AS graphrag_answer,
           first(text ORDER BY turn) FILTER (role = 'assistant') AS vanilla_answer, CAST(greatest(max(turn) FILTER (role = 'user'), max(turn) FILTER (role = 'assistant')) AS BIGINT) AS latency_ms
    FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0 AND count(*) FILTER (role = 'user') > 0""")
def compare_log(spark, sf):
    c = d.table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id")
    side = lambda role: c.filter(F.col("role") == role).groupBy("query_id").agg(
        F.min_by("text", "turn").alias("answer"), F.max("turn").alias("latency_ms"))
    asked = c.select("query_id", F.concat(F.lit("conversation "), F.col("query_id").cast("string")).alias("question")).distinct()
    both = compare.compare(asked, side("user"), side("assistant"))
    return compare.log_rows(both, F.current_timestamp()).select("query_text", "graphrag_answer", "vanilla_answer", "latency_ms")


@query("k2_votes", """
    SELECT user_id AS query_log_id, coalesce(arg_max(CASE event_type WHEN 'click' THEN 'graphrag' ELSE 'vanilla' END, event_id) FILTER (event_type IN ('click', 'view')), 'tie_bad') AS compare_verdict
    FROM events GROUP BY user_id""")
def votes(spark, sf):
    e = d.table(spark, sf, "events")
    cast = e.select(F.col("user_id").alias("query_log_id"), F.col("event_id").alias("seq"),
                    F.when(F.col("event_type") == "click", "graphrag").when(F.col("event_type") == "view", "vanilla").otherwise(F.col("event_type")).alias("verdict"))
    log = e.select(F.col("user_id").alias("query_log_id")).distinct().withColumn("compare_verdict", F.lit("tie_bad"))
    return compare.vote(log, cast)


def _results(spark, sf):
    x = d.table(spark, sf, "labels").join(d.table(spark, sf, "documents"), "doc_id")
    half = F.when(F.col("n_chars") > 1000, F.lit(0.5)).otherwise(F.lit(0.0))
    return x.select("doc_id", F.col("lang").alias("category"), F.col("quality").cast("double").alias("graph_score"), (1 - half).alias("graph_recall"),
                    F.col("toxic").cast("double").alias("plain_score"), half.alias("plain_recall"), F.col("n_chars").alias("latency_ms"))


@query("a8_eval_summary", """
    SELECT lang AS category, count(*) AS n, round_even(avg(quality), 3) AS graph_score, round_even(avg(CASE WHEN n_chars > 1000 THEN 0.5::DOUBLE ELSE 1 END), 3) AS graph_recall,
           round_even(avg(toxic), 3) AS plain_score, round_even(avg(CASE WHEN n_chars > 1000 THEN 0.5::DOUBLE ELSE 0 END), 3) AS plain_recall, round_even(avg(n_chars), 3) AS latency_ms
    FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def eval_summary(spark, sf):
    return evals.summarise(_results(spark, sf))


@query("a10_wins", """
    SELECT doc_id, lang AS category FROM labels JOIN documents USING (doc_id) WHERE quality > toxic ORDER BY doc_id LIMIT 5""")
def eval_wins(spark, sf):
    return evals.wins(_results(spark, sf), "doc_id").select("doc_id", "category")


@query("a9_recall", """
    WITH src AS (SELECT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
    cite AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N')
    SELECT o_orderkey AS question_id, coalesce(round(avg(CASE WHEN s.l_orderkey IS NULL THEN NULL WHEN c.p_name IS NULL THEN 0.0 ELSE 1.0 END), 9), 1.0) AS recall
    FROM orders LEFT JOIN src s ON s.l_orderkey = o_orderkey LEFT JOIN cite c ON c.l_orderkey = s.l_orderkey AND c.p_name = s.p_name GROUP BY o_orderkey""")
def recall(spark, sf):
    li = d.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    named = li.join(d.table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select(
        F.col("l_orderkey").alias("question_id"), F.concat(F.initcap("p_name"), F.lit(" (v2)")).alias("title"), "l_returnflag", "p_name")
    questions = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"))
    cited = named.filter("l_returnflag <> 'N'").select("question_id", F.col("p_name").alias("title"))
    return evals.recall(questions, named.select("question_id", "title"), cited).withColumn("recall", F.round("recall", 9))


@query("f22_score_clamp", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE least(1.0, greatest(0.0, value / 50 - 0.2)) END AS score FROM events""")
def score_clamp(spark, sf):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise((F.col("value") / 50 - 0.2).cast("string"))
    return d.table(spark, sf, "events").select("event_id", evals.clamp_score(raw).alias("score"))


@query("r2_r4_latest_status", """
    SELECT user_id AS job_id, arg_max(event_type, ts) AS status FROM events GROUP BY user_id""")
def latest_status(spark, sf):
    history = d.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts")
    return jobs.latest_status(history).select("job_id", "status")


@query("r3_outcomes", """
    SELECT doc_id, quality = 1 AS keep_chunks, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS paper_status,
           CASE WHEN quality = 1 AND toxic = 0 THEN 'completed' ELSE 'failed' END AS job_status FROM labels""")
def outcomes(spark, sf):
    return d.table(spark, sf, "labels").select("doc_id", jobs.outcome(F.col("quality") == 1, F.col("toxic") == 0).alias("o")).select("doc_id", "o.*")


def _requests(spark, sf):
    return d.table(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("client"), F.col("ts").cast("timestamp").alias("ts"))


@query("r5_recent_requests", """
    SELECT event_id AS request_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def recent_requests(spark, sf):
    return jobs.recent_requests(_requests(spark, sf), 3600).select("request_id", "recent")


@query("r6_over_limit", """
    SELECT event_type AS client, epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > 4""")
def over_limit(spark, sf):
    return jobs.over_limit(_requests(spark, sf), 4, "1 hour").withColumn("window_start", F.unix_seconds("window_start"))


@query("r1_stream_ingest", """
    SELECT CAST(event_id AS VARCHAR) AS paper_id, upper(event_type) AS kind FROM events""")
def stream_ingest(spark, sf):
    """Events as arriving papers, through the streaming job, read back from its sink."""
    schema = d.table(spark, sf, "events").schema
    target, marks = scratch_folder(spark, "ingested"), scratch_folder(spark, "stream-marks")
    arrivals = jobs.stream_tables(spark, sf, schema, "events.parquet").select(F.col("event_id").cast("string").alias("paper_id"), "event_type")
    run = jobs.ingest(arrivals, lambda batch: batch.select("paper_id", F.upper("event_type").alias("kind")), target, marks)
    run.awaitTermination()
    return spark.read.parquet(target).select("paper_id", "kind")


@query("r2_stream_states", """
    SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, 2 AS states FROM events""")
def stream_states(spark, sf):
    """States the stream itself writes; events of errors yield no rows, so their jobs fail. The same events again change nothing."""
    schema = d.table(spark, sf, "events").schema
    target, marks = scratch_folder(spark, "ingested"), scratch_folder(spark, "stream-marks")
    for _ in range(2):
        arrivals = jobs.stream_tables(spark, sf, schema, "events.parquet").select(F.col("event_id").cast("string").alias("paper_id"), "event_type")
        jobs.ingest(arrivals, lambda batch: batch.filter("event_type <> 'error'"), target, marks).awaitTermination()
    history = spark.read.parquet(jobs.states_folder(target)).select("job_id", "status", "ts")
    return jobs.latest_status(history).join(history.groupBy("job_id").agg(F.count("*").cast("int").alias("states")), "job_id").select("job_id", "status", "states")


@query("r7_unfinished_sections", """
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, lang AS section FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def unfinished_sections(spark, sf):
    folder = scratch_folder(spark, "finished")
    docs = d.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.col("lang").alias("section"), "doc_id")
    done = docs.join(d.table(spark, sf, "labels"), "doc_id").select(
        "paper_id", "section", F.lit("entities").alias("kind"), F.when(F.col("quality") == 1, F.lit("{}")).otherwise(F.lit("{broken")).alias("data"))
    checkpoints.save(done, folder)
    return checkpoints.unfinished(docs.select("paper_id", "section"), checkpoints.load(spark, folder, "entities"))


@query("k11_new_chunks", """
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY doc_id""")
def new_chunks(spark, sf):
    from citeloom.operators.merge import insert_new

    incoming = documents(spark, sf).select("paper_id", "text")
    return insert_new(d.corpus(spark, sf).chunk_vectors, incoming, ["paper_id"]).groupBy("paper_id").agg(F.count("*").alias("n"))


@query("k16_partial_chunks", """
    SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def partial_chunks(spark, sf):
    from citeloom.operators.build import drop_chunks_of

    chunks = d.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("paper_id"))
    failed = d.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("paper_id"))
    return drop_chunks_of(chunks, failed).select(F.col("doc_id").alias("chunk_id"))


@query("s17_dump", """
    SELECT label, count(*) AS n FROM embeddings GROUP BY label""")
def dump(spark, sf):
    """Vectors written as JSON lines and read back."""
    folder = scratch_folder(spark, "dump")
    rows = d.table(spark, sf, "embeddings")
    rows.write.json(folder)
    return spark.read.schema(rows.schema).json(folder).filter(F.size("embedding") > 0).groupBy("label").agg(F.count("*").alias("n"))


@query("u6_u16_graph_from_text")
def graph_from_text(spark, sf):
    """Conversations as sectioned papers, taken through extraction, resolution, linking and merging into the part names."""
    from citeloom.functions.text import split_sections
    from citeloom.operators.build import EDGE_FIELDS, build_graph, extract_batch
    from citeloom.plans.text import threads
    from citeloom.schema import EDGES, NODES

    none = F.lit(None).cast("string")
    papers = written(threads(spark, sf).select(
        "paper_id", F.concat(F.lit("Thread "), "paper_id").alias("title"), F.array(F.concat(F.lit("Author "), F.col("paper_id"))).alias("authors"),
        F.lit(None).cast("int").alias("year"), none.alias("venue"), none.alias("abstract"), none.alias("collection_id"),
        split_sections(F.col("text")).alias("sections")), "papers")
    names = d.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    stored = names.select(*[
        {"node_id": F.concat(F.lit("m:"), "name"), "label": F.lit("Method"), "name": F.col("name")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in NODES.fields])
    edges = spark.createDataFrame([], EDGES).select("src", "dst", "rel_type", *EDGE_FIELDS, "occurrence_count")
    found = extract_batch(papers, stored, [offline_entities], d.DIMENSION)
    built = build_graph(papers, found, stored, edges, dimension=d.DIMENSION)
    return built["edges"].select("src", "dst", "rel_type", "occurrence_count")


def silent_model():
    """A model that finds nothing."""
    return lambda system, prompt: "{}"


@query("u6_ingestion_run", """
    SELECT CAST(conv_id AS VARCHAR) AS paper_id, 'completed' AS status, 0 AS entities_found, 1 AS author_edges, count(*) FILTER (trim(text) <> '') > 0 AS chunked,
           'Thread ' || conv_id AS title, 0 AS open_units FROM conversations GROUP BY conv_id""")
def ingestion_run(spark, sf):
    """Conversations as papers, taken into a stored graph: half of them, then the whole table, of which the rest is new."""
    from citeloom.functions.text import split_sections
    from citeloom.operators.ingest import ingest_batch, open_store
    from citeloom.plans.text import threads

    none = F.lit(None).cast("string")
    papers = written(threads(spark, sf).select(
        "paper_id", F.concat(F.lit("Thread "), "paper_id").alias("title"), F.array(F.concat(F.lit("Author "), F.pmod(F.col("paper_id").cast("int"), F.lit(7)).cast("string"))).alias("authors"),
        F.lit(None).cast("int").alias("year"), none.alias("venue"), none.alias("abstract"), none.alias("collection_id"),
        split_sections(F.col("text")).alias("sections")), "papers")
    store = open_store(spark, scratch_folder(spark, "graph"), buckets=8)
    for batch in (papers.filter("paper_id % 2 = 0"), papers):
        ingest_batch(store, batch, [silent_model], dimension=d.DIMENSION, pause=0)
    edges = store.read("edges").filter("rel_type = 'AUTHORED_BY'").groupBy(F.col("src").alias("node_id")).agg(F.sum("occurrence_count").cast("int").alias("author_edges"))
    chunks = store.read("chunks").filter(F.size("vector") == d.DIMENSION).select("paper_id").distinct().withColumn("chunked", F.lit(True))
    units = store.read("units").groupBy("paper_id").agg(F.count("*").cast("int").alias("open_units"))
    nodes = store.read("nodes").filter("label = 'Paper'").select("node_id", "paper_id", "title").join(edges, "node_id", "left").drop("node_id")
    return (store.read("jobs").select("paper_id", "status", "entities_found").join(nodes, "paper_id", "left").join(chunks, "paper_id", "left")
            .join(units, "paper_id", "left").na.fill(False, ["chunked"]).na.fill(0, ["open_units"]))


@query("s14_eval_questions", """
    SELECT CAST(item_id AS VARCHAR) AS id, md5(text) AS digest FROM benchmark""")
def eval_questions(spark, sf):
    """Benchmark passages as evaluation sets of one question per line, written and read back."""
    folder = scratch_folder(spark, "questions")
    rows = d.table(spark, sf, "benchmark").select(F.array(F.struct(F.lit("p").alias("id"))).alias("papers"), F.array(
        F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"))).alias("questions"))
    rows.write.json(folder)
    return feeds.evaluation_set(spark, folder, multi_line=False)[1].select("id", F.md5("question").alias("digest"))


@query("p3_equality_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src7'")
def equality_filter(spark, sf):
    where = {"lang": "en", "source": "src7"}
    rows = d.table(spark, sf, "documents")
    for column, value in where.items():
        rows = rows.filter(F.col(column) == value)
    return rows.select("doc_id")


@query("s12_s13_vectors_by_id", """
    SELECT label, count(*) AS n FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY label""")
def vectors_by_id(spark, sf):
    wanted = d.table(spark, sf, "labels").filter("toxic = 0").select(F.col("doc_id").alias("vec_id"))
    return d.table(spark, sf, "embeddings").select("vec_id", "label").join(wanted, "vec_id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


