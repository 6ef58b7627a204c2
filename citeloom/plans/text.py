"""Registered queries: text functions, chunking, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import names, replies
from citeloom.functions import text as t
from citeloom.functions.vectors import embed
from citeloom.operators.chunks import chunk_papers
from citeloom.operators.search import in_collection, search, searchable
from citeloom.operators.search_index import INDEX_TABLES, index_texts, search_stored, unindex
from citeloom.plans import domain as d
from citeloom.plans.domain_sql import tok, using
from citeloom.plans.registry import ORACLES, query
from citeloom.runtime import scratch_folder, spread
from citeloom.sources.snapshots import Snapshots

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
COLLAPSE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_HEADINGS = ("", "Abstract\n", "1. Introduction\n", "II. METHODS\n", "3.2. Results \n", "introduction\n",
             "References\n", "Appendix\n")


def threads(spark, sf):
    """Conversations as sectioned papers: every turn under a heading line, in turn order."""
    c = d.table(spark, sf, "conversations")
    heading = F.get(F.array(*[F.lit(h) for h in _HEADINGS]), F.pmod("turn", F.lit(len(_HEADINGS))).cast("int"))
    return c.groupBy(F.col("conv_id").cast("string").alias("paper_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(heading, "text").alias("part")))),
                                 lambda x: x["part"]), "\n").alias("text"))


def documents(spark, sf):
    """Documents as papers of one section."""
    return spread(d.table(spark, sf, "documents")).select(
        F.col("doc_id").cast("string").alias("paper_id"), "text", F.col("source").alias("collection_id"), "lang")


def _sentence_rows():
    one = F.array(F.struct(F.lit(0).alias("ord"), F.lit("full_text").alias("name"), F.col("text").alias("text")))
    return one.alias("sections")


@query("f1_norm_name", f"""
    SELECT doc_id, md5({COLLAPSE.format('lower(text)')}) AS norm FROM documents""")
def norm_name(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", F.md5(t.norm_name(F.col("text"))).alias("norm"))


_SECTIONS = r"""
    WITH lines AS (
        SELECT conv_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT conv_id, string_agg(list_extract(['', 'Abstract' || chr(10), '1. Introduction' || chr(10), 'II. METHODS' || chr(10),
                '3.2. Results ' || chr(10), 'introduction' || chr(10), 'References' || chr(10), 'Appendix' || chr(10)], CAST(turn % 8 + 1 AS INTEGER)) || text,
                chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)),
    marked AS (SELECT *, CASE WHEN regexp_full_match(line, '(?i)\s*(?:[\divx]+[.\)]\s*)*(abstract|introduction|related work|background|method|methods|methodology|approach|model architecture|architecture|proposed method|system description|training|experiments|experimental setup|evaluation|results|discussion|conclusion|conclusions|future work|limitations|acknowledgments|acknowledgements|references|appendix)\s*')
            THEN regexp_replace(lower(trim(line)), '^(?:[\divx]+[.\)]\s*)*', '') END AS head FROM lines),
    placed AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos), 'preamble') AS name FROM marked),
    bodies AS (SELECT conv_id, name, min(pos) AS place,
                      coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY pos) FILTER (head IS NULL), '^\s+|\s+$', '', 'g'), '') AS text
               FROM placed GROUP BY conv_id, name),
    kept AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS ord FROM bodies WHERE text <> ''),
    sections AS (SELECT CAST(conv_id AS VARCHAR) AS paper_id, CAST(ord AS INTEGER) AS ord, name, text FROM kept WHERE n > 1)
"""


@query("f7_sections", _SECTIONS + "SELECT paper_id, ord, name, text FROM sections")
def sections(spark, sf):
    cut = threads(spark, sf).select("paper_id", F.inline(t.split_sections(F.col("text"))))
    return cut.filter(F.col("name") != "full_text").select("paper_id", "ord", "name", "text")


@query("f7_unsectioned", "SELECT doc_id, md5(text) AS digest FROM documents")
def unsectioned(spark, sf):
    cut = spread(d.table(spark, sf, "documents")).select("doc_id", F.inline(t.split_sections(F.col("text"))))
    return cut.filter(F.col("name") == "full_text").select("doc_id", F.md5("text").alias("digest"))


@query("p17_content_sections", _SECTIONS + """
    SELECT name, count(*) AS n FROM sections WHERE name NOT IN ('references', 'acknowledgments', 'acknowledgements') GROUP BY name""")
def content_sections(spark, sf):
    return sections(spark, sf).filter(~F.col("name").isin(*t.NON_CONTENT_SECTIONS)).groupBy("name").agg(F.count("*").alias("n"))


@query("p18_section_pieces", r"""
    SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS kept, true AS fits FROM documents""")
def section_pieces(spark, sf):
    pieces = t.section_pieces(F.col("text"), 10_000)
    kept = F.aggregate(pieces, F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"\s", "")))
    return d.table(spark, sf, "documents").select("doc_id", kept.cast("long").alias("kept"), F.forall(pieces, lambda x: F.length(x) <= 10_000).alias("fits"))


@query("p18_truncated", r"""
    SELECT doc_id, md5(CASE WHEN length(text) <= 10000 THEN text ELSE substr(text, 1, 10000) || chr(10) || '[truncated]' END) AS digest FROM documents""")
def truncated(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", F.md5(t.truncate_section(F.col("text"), 10_000)).alias("digest"))


@query("p19_scrubbed_preamble", rf"""
    SELECT doc_id, md5({STRIP.format(r"regexp_replace(regexp_replace(CASE WHEN title <> '' THEN substr(text, length(title) + 1) ELSE text END, '\{[\p{L}\p{N}_\s,]+\}@[\p{L}\p{N}_.]+', '', 'g'), '[\p{L}\p{N}_.]+@[\p{L}\p{N}_.]+\.[\p{L}\p{N}_]+', '', 'g')")}) AS digest
    FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM documents)""")
def scrubbed_preamble(spark, sf):
    title = F.substring_index("text", "\n", 1)
    return d.table(spark, sf, "documents").select("doc_id", F.md5(t.scrub_preamble(F.col("text"), title)).alias("digest"))


@query("f8_references", r"""
    WITH lists AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 2 = 0 THEN '[' || (turn + 1) || '] ' ELSE '' END || text, chr(10) ORDER BY turn) AS text
                   FROM conversations GROUP BY conv_id),
    marked AS (SELECT conv_id, string_split(regexp_replace(text, '\n(\[?\d{1,3}\]?[.\s])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM lists)
    SELECT conv_id, len(list_filter(parts, lambda p: trim(p, ' ' || chr(10) || chr(9)) <> '')) AS n, replace(regexp_replace(parts[1], '^\s+|\s+$', '', 'g'), chr(10), ' ') AS first_entry FROM marked""")
def references(spark, sf):
    mark = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "))).otherwise("")
    lists = d.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, "text").alias("x")))), lambda x: x["x"]), "\n").alias("text"))
    entries = t.split_references(F.col("text"))
    return lists.select("conv_id", F.size(entries).cast("long").alias("n"), F.get(entries, F.lit(0)).alias("first_entry"))


_SENTENCES = r"""
    WITH RECURSIVE cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
                        lambda s: regexp_replace(s, '\s+', '', 'g') <> '') AS parts FROM documents),
    sentences AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS i FROM cut)
"""


@query("f12_sentences", _SENTENCES + "SELECT doc_id, i, md5(sentence) AS digest FROM sentences")
def sentence_rows(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", F.posexplode(t.split_sentences(F.col("text"))).alias("i", "s")).select(
        "doc_id", F.col("i").cast("long").alias("i"), F.md5("s").alias("digest"))


@query("f16_token_count", f"SELECT doc_id, {tok('text')} AS n FROM documents")
def token_counts(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", t.token_count(F.col("text")).cast("long").alias("n"))


def _chunk_sql(size: int, overlap: int) -> str:
    return _SENTENCES + f""",
    counted AS (SELECT doc_id, i, sentence, {tok('sentence')} AS n FROM sentences),
    running AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total, count(*) OVER (PARTITION BY doc_id) AS size FROM counted),
    fill AS (SELECT s.doc_id, s.i AS s, coalesce(min(e.i), any_value(s.size)) AS e
             FROM running s LEFT JOIN running e ON e.doc_id = s.doc_id AND e.i >= s.i AND e.i <= s.i + {size + 1}
                  AND (e.n > {size} OR e.total - s.total + s.n > {size}) GROUP BY s.doc_id, s.i),
    back AS (SELECT e.doc_id, e.i AS e, coalesce(min(b.i), e.i - 1) AS b
             FROM running e LEFT JOIN running b ON b.doc_id = e.doc_id AND b.i < e.i AND b.i >= e.i - {overlap}
                  AND e.total - e.n - b.total + b.n <= {overlap} GROUP BY e.doc_id, e.i),
    jumps AS (SELECT f.doc_id, f.s, f.e, CASE WHEN h.n > {size} THEN f.s + 1 WHEN f.e = h.size THEN NULL WHEN t.n > {size} THEN f.e
                     WHEN t.total - c.total + c.n > {size} THEN f.e ELSE c.i END AS next, h.n > {size} AS big
              FROM fill f JOIN running h ON h.doc_id = f.doc_id AND h.i = f.s LEFT JOIN running t ON t.doc_id = f.doc_id AND t.i = f.e
              LEFT JOIN back b ON b.doc_id = f.doc_id AND b.e = f.e LEFT JOIN running c ON c.doc_id = f.doc_id AND c.i = greatest(f.s, b.b)),
    spans AS (SELECT doc_id, s, e, next, big FROM jumps WHERE s = 0
              UNION ALL SELECT j.doc_id, j.s, j.e, j.next, j.big FROM spans p JOIN jumps j ON j.doc_id = p.doc_id AND j.s = p.next),
    texts AS (SELECT p.doc_id, s, 0 AS part, string_agg(sentence, ' ' ORDER BY c.i) AS text FROM spans p JOIN counted c ON c.doc_id = p.doc_id AND c.i >= s AND c.i < e WHERE NOT big GROUP BY p.doc_id, s, e
              UNION ALL SELECT doc_id, i, part, array_to_string(list_slice(parts, part * {size} + 1, part * {size} + {size}), '')
              FROM (SELECT doc_id, i, regexp_extract_all(sentence, '\\s*(?:[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s])') AS parts, unnest(range(0, CAST(ceil(n / {size}.0) AS BIGINT))) AS part FROM counted WHERE n > {size})),
    numbered AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, part) - 1 AS INTEGER) AS chunk_index, text FROM texts)
    """


@query("f13_f14_chunks", _chunk_sql(1000, 200) + "SELECT CAST(doc_id AS VARCHAR) AS paper_id, chunk_index, md5(text) AS digest FROM numbered")
def chunks(spark, sf):
    papers = documents(spark, sf).select("paper_id", _sentence_rows())
    return chunk_papers(papers).select("paper_id", "chunk_index", F.md5("text").alias("digest"))


@query("f15_chunk_pages", _chunk_sql(60, 15) + rf"""
    , lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
    clean AS (SELECT doc_id, no, {COLLAPSE.format('line')} AS line FROM lines),
    ends AS (SELECT doc_id, no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) AS till FROM clean),
    whole AS (SELECT doc_id, string_agg(line, ' ' ORDER BY no) AS text FROM clean GROUP BY doc_id),
    placed AS (SELECT n.doc_id, chunk_index, instr(w.text, substr({COLLAPSE.format('n.text')}, 1, 40)) - 1 AS pos FROM numbered n JOIN whole w USING (doc_id))
    SELECT CAST(p.doc_id AS VARCHAR) AS paper_id, chunk_index, CASE WHEN any_value(pos) >= 0 THEN CAST(1 + count(e.no) AS INTEGER) END AS page_number
    FROM placed p LEFT JOIN ends e ON e.doc_id = p.doc_id AND e.till <= p.pos GROUP BY p.doc_id, chunk_index""")
def chunk_pages(spark, sf):
    """Documents as papers of one page per line."""
    papers = documents(spark, sf).select("paper_id", _sentence_rows(), F.split("text", "\n").alias("pages"))
    return chunk_papers(papers, 60, 15).select("paper_id", "chunk_index", "page_number")


@query("f17_json_recovery", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_recovery(spark, sf):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Anything else?"))).otherwise(F.col("props"))
    return d.table(spark, sf, "events").select(
        "event_id", F.get_json_object(replies.recover_json(wrapped), "$.k").cast("long").alias("k"))


@query("p10_confidence", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE least(1.0, greatest(0.0, o_totalprice / 400000 - 0.1)) END AS confidence FROM orders""")
def confidence(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", "high").otherwise((F.col("o_totalprice") / 400000 - 0.1).cast("string"))
    return d.table(spark, sf, "orders").select("o_orderkey", replies.confidence(raw).alias("confidence"))


@query("p11_type_whitelist", """
    SELECT upper(trim(event_type)) AS kind, count(*) AS n FROM events WHERE upper(trim(event_type)) IN ('CLICK', 'VIEW') GROUP BY kind""")
def type_whitelist(spark, sf):
    kind = F.upper(t.strip(F.col("event_type")))
    return d.table(spark, sf, "events").select(kind.alias("kind")).filter(F.col("kind").isin("CLICK", "VIEW", "RESULT")).groupBy(
        "kind").agg(F.count("*").alias("n"))


@query("p12_name_grounding", """
    SELECT lang, count(*) FILTER (contains(text, list_extract(string_split(text, ' '), -1))) AS grounded, count(*) FILTER (contains(text, upper(source))) AS invented
    FROM documents GROUP BY lang""")
def name_grounding(spark, sf):
    last = F.element_at(F.split("text", " "), -1)
    return d.table(spark, sf, "documents").groupBy("lang").agg(
        F.count_if(F.contains("text", last)).alias("grounded"), F.count_if(F.contains("text", F.upper("source"))).alias("invented"))


@query("p20_trivial_claims", r"""
    SELECT doc_id, len(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) < 5
           AND NOT regexp_matches(text, '(?i)\b(is|are|was|were|has|have|had|can|could|will|would|shows?|showed|achiev\w*|outperform\w*|propos\w*|introduc\w*|demonstrat\w*|obtain\w*|report\w*|present\w*|train\w*|improv\w*|reduc\w*|find|finds|found|enable\w*|allow\w*)\b') AS trivial
    FROM documents""")
def trivial_claims(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", t.is_trivial_claim(F.col("text")).alias("trivial"))


@query("f19_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("f20_arxiv_id", """
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '1706.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || 'v2' ELSE 'cs.CL/' || lpad(CAST(page_id AS VARCHAR), 7, '0') END AS arxiv_id
    FROM pages""")
def arxiv_ids(spark, sf):
    n = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" https://arxiv.example/pdf/1706."), F.lpad(n, 5, "0"), F.lit("v2.PDF"))).otherwise(
        F.concat(F.lit("https://arxiv.example/abs/cs.CL/"), F.lpad(n, 7, "0")))
    return d.table(spark, sf, "pages").select("page_id", t.arxiv_id(link).alias("arxiv_id"))


@query("f21_norm_title", r"""
    SELECT doc_id, regexp_replace(lower(regexp_replace(text, '\s*\([^)]*\)\s*$', '')), '[^a-z0-9]', '', 'g') AS norm FROM documents""")
def norm_titles(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", t.norm_title(F.col("text")).alias("norm"))


@query("f25_yes_no", r"""
    SELECT conv_id, turn, contains(lower(split_part(regexp_replace(text, '^\s+', ''), chr(10), 1)), 'yes') AS yes FROM conversations""")
def yes_no(spark, sf):
    return d.table(spark, sf, "conversations").select("conv_id", "turn", t.says_yes(F.col("text")).alias("yes"))


@query("f26_collapsed", f"SELECT page_id, md5({COLLAPSE.format('html')}) AS digest FROM pages")
def collapsed(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", F.md5(t.collapse(F.col("html"))).alias("digest"))


def _pairs(spark, sf):
    """Distinct part names against the names that share their first word (an equi-join)."""
    p = d.table(spark, sf, "part").select("p_name", F.substring_index("p_name", " ", 1).alias("word")).distinct()
    return p.select("word", F.concat("p_name", F.lit(" v2")).alias("a")).join(p.withColumnRenamed("p_name", "b"), "word").select("a", "b")


_PAIRS = """WITH p AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS word FROM part),
    pairs AS (SELECT x.p_name || ' v2' AS a, y.p_name AS b FROM p x JOIN p y USING (word))"""


@query("f2_prefix_variant", _PAIRS + " SELECT a, b, starts_with(a, b) AS hit FROM pairs")
def prefix_variant(spark, sf):
    return _pairs(spark, sf).select("a", "b", names.is_prefix_variant(F.col("a"), F.col("b")).alias("hit"))


@query("f3_acronym_variant", """
    SELECT DISTINCT p_name, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS short, true AS hit FROM part""")
def acronym_variant(spark, sf):
    short = F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.substring_index("p_name", " ", -1), 1, 1)))
    return d.table(spark, sf, "part").select("p_name", short.alias("short")).distinct().select(
        "p_name", "short", names.is_acronym_variant(F.col("p_name"), F.col("short")).alias("hit"))


@query("f4_containment", r"""
    SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS word, true AS whole, false AS partial FROM part""")
def containment(spark, sf):
    word = F.substring_index("p_name", " ", -1)
    return d.table(spark, sf, "part").select("p_name", word.alias("word")).distinct().select(
        "p_name", "word", names.is_contained(F.col("p_name"), F.col("word")).alias("whole"),
        names.is_contained(F.col("p_name"), F.substring("word", 2, 10)).alias("partial"))


@query("f5_name_similarity")
def name_similarity(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(names.name_similarity(F.col("a"), F.col("b")), 6).alias("score"))


@query("f6_ratio")
def edit_ratio(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(names.ratio(F.col("a"), F.col("b")), 6).alias("ratio"),
                                    F.round(names.partial_ratio(F.col("a"), F.col("b")), 6).alias("partial"))


@query("f6_indel_ratio", _PAIRS.replace("WITH p", "WITH RECURSIVE p") + """,
    lcs(a, b, i, row) AS (
        SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM pairs
        UNION ALL
        SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
            lambda k: greatest(row[k + 1], row[k] + CASE WHEN b[k] = a[i + 1] THEN 1 ELSE 0 END)))))
        FROM lcs WHERE i < length(a))
    SELECT a, b, round(200.0::DOUBLE * row[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM lcs WHERE i = length(a)""")
def indel_ratio(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(names.ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("p13_claim_grounding")
def claim_grounding(spark, sf):
    """First sentences of documents as claims against the rest of their own text."""
    first = F.get(t.split_sentences(F.col("text")), F.lit(0))
    rest = F.substring(F.col("text"), F.length(first) + 1, F.length("text"))
    return spread(d.table(spark, sf, "documents")).select("doc_id", names.grounded(first, rest, 40.0).alias("grounded"))


@query("v1_embedding_norm", r"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM documents""")
def embedding_norm(spark, sf):
    vec = spread(d.table(spark, sf, "documents")).select("doc_id", embed(F.col("text"), 64).alias("v"))
    square = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return vec.select("doc_id", F.round(F.sqrt(square), 5).alias("norm"))


_SEARCH = """
    words AS (SELECT node_id, label, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM texts),
    sizes AS (SELECT label, count(*) AS n_docs, avg(len(w)) AS mean_words FROM words GROUP BY label),
    postings AS (SELECT label, node_id, len(w) AS n_words, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM words) GROUP BY ALL),
    spread AS (SELECT label, term, count(*) AS df FROM postings GROUP BY ALL),
    scored AS (SELECT query_id, label, node_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / mean_words)))), 6) AS score
               FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM asked)
               JOIN postings USING (term) JOIN spread USING (label, term) JOIN sizes USING (label) GROUP BY ALL),
    in_label AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, node_id) AS r FROM scored QUALIFY r <= 20)
    SELECT query_id, node_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank
    FROM in_label QUALIFY rank <= 20"""


@query("x1_search_documents", """
    WITH texts AS (SELECT 'd:' || doc_id AS node_id, lang AS label, text FROM documents),
    asked AS (SELECT item_id AS query_id, text FROM benchmark),""" + _SEARCH)
def search_documents(spark, sf):
    texts = d.table(spark, sf, "documents").select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("node_id"), F.col("lang").alias("label"), "text")
    return search(texts, d.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("x1_search_nodes", using("nodes") + """
    , texts AS (SELECT node_id, label, concat_ws(' ', name, title, text) AS text FROM nodes),
    asked AS (SELECT DISTINCT p_name AS query_id, p_name || ' quantity 7' AS text FROM part),""" + _SEARCH)
def search_nodes(spark, sf):
    asked = d.table(spark, sf, "part").select(F.col("p_name").alias("query_id")).distinct()
    asked = asked.withColumn("text", F.concat("query_id", F.lit(" quantity 7")))
    return search(searchable(d.corpus(spark, sf).nodes), asked)


@query("x1_stored_index", ORACLES["x1_search_nodes"])
def stored_index(spark, sf):
    """All nodes indexed in two batches, papers with other texts before; a third takes out what was too much."""
    texts = searchable(d.corpus(spark, sf).nodes)
    early = texts.filter(F.col("label").isin("Paper", "Method")).withColumn("text", F.concat(F.lit("draft "), "text"))
    surplus = early.withColumn("node_id", F.concat(F.lit("draft:"), "node_id"))
    store = Snapshots(spark, scratch_folder(spark, "index"), INDEX_TABLES, buckets=8)
    store.change(lambda c: index_texts(c, early.unionByName(surplus)))
    store.change(lambda c: index_texts(c, texts))
    store.change(lambda c: unindex(c, surplus))
    asked = d.table(spark, sf, "part").select(F.col("p_name").alias("query_id")).distinct()
    return search_stored(store, asked.withColumn("text", F.concat("query_id", F.lit(" quantity 7"))))


@query("p9_scoped_search", using("nodes", "edges") + """
    , texts AS (SELECT node_id, label, concat_ws(' ', name, title, text) AS text FROM nodes),
    ours AS (SELECT node_id, paper_id FROM nodes WHERE collection_id = '2-HIGH'),
    allowed AS (SELECT node_id FROM ours UNION ALL SELECT node_id FROM nodes WHERE label = 'Claim' AND source_paper_id IN (SELECT paper_id FROM ours)
                UNION ALL SELECT node_id FROM nodes WHERE label IN ('Method', 'Dataset', 'Author') AND node_id IN (SELECT dst FROM edges WHERE src IN (SELECT node_id FROM ours))),
    asked AS (SELECT DISTINCT p_name AS query_id, p_name AS text FROM part),""" + _SEARCH.replace(
    "USING (label) GROUP BY ALL)", "USING (label) WHERE node_id IN (SELECT node_id FROM allowed) GROUP BY ALL)"))
def scoped_search(spark, sf):
    corpus = d.corpus(spark, sf)
    asked = d.table(spark, sf, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    return search(searchable(corpus.nodes), asked, within=in_collection(corpus.nodes, corpus.edges, "2-HIGH"))
