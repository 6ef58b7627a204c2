from pyspark.sql import functions as F

from citeloom.operators import context as ctx
from citeloom.operators import ranking
from citeloom.settings import effective_hops, effective_k

EDGES = "query_id long, src string, dst string, rel_type string, conf double, ord int"
SEEDS = "query_id long, node_id string, score double"
CHUNKS = "query_id long, paper_id string, section_name string, text string, score double, rank int"


def test_zero_means_default():
    assert [effective_hops(h) for h in (None, 0, 1, 4, 9, -3)] == [2, 2, 1, 4, 4, 1]
    assert effective_k(0, 20) == effective_k(None, 20) == 20 and effective_k(3, 20) == 3


def scored(spark, **weights):
    nodes = spark.createDataFrame([(1, "s", 1, "Method", None), (1, "p", 2, "Paper", "P"), (1, "d", 3, "Dataset", None), (1, "far", 4, "Author", None)],
                                  "query_id long, node_id string, node_ord int, label string, paper_id string")
    edges = spark.createDataFrame([(1, "s", "p", "EXTENDS", 0.8, 1), (1, "p", "d", "EXTENDS", 0.0, 2), (1, "d", "d", "EXTENDS", 0.6, 3)], EDGES)
    dist = spark.createDataFrame([(1, "s", 0), (1, "p", 1), (1, "d", 2)], "query_id long, node_id string, distance int")
    entities = spark.createDataFrame([(1, "s", 0.9)], SEEDS)
    chunks = spark.createDataFrame([(1, "P", "x", "t", 0.3, 1), (1, "P", "x", "t", 0.5, 2), (1, "P", "x", "t", -0.2, 3)], CHUNKS)
    return ranking.score_nodes(nodes, edges, dist, entities, chunks, **weights)


def test_score_arithmetic(spark):
    got = {r.node_id: r for r in scored(spark).collect()}
    assert got["s"].score == round(0.4 * 0.9 + 0.4 * 1 + 0.2 * 0.8, 9)  # seeds count as distance 1
    assert got["p"].score == round(0.4 * 0.5 + 0.4 * 1 + 0.2 * 0.4, 9)  # best chunk wins
    assert got["d"].score == round(0.4 * 0.5 + 0.2 * 0.3, 9)  # a self-loop counts once
    assert got["far"].score == 0 and got["far"].distance is None


def test_zero_weight_is_honoured(spark):
    got = {r.node_id: r.score for r in scored(spark, alpha=0, beta=0, gamma=1).collect()}
    assert got["s"] == 0.8 and got["far"] == 0


def test_negative_chunk_scores_floor_at_zero(spark):
    chunks = spark.createDataFrame([(1, "P", "x", "t", -0.2, 1), (1, "", "x", "t", 0.9, 2)], CHUNKS)
    assert [(r.paper_id, r.chunk_score) for r in ranking.best_chunk_score(chunks).collect()] == [("P", 0.0)]


def test_rank_ties_and_induced_edges(spark):
    nodes = spark.createDataFrame([(1, "a", 1, "Claim", 0.5), (1, "b", 2, "Dataset", 0.5), (1, "c", 3, "Paper", 0.5), (1, "d", 4, "Method", 0.5), (1, "e", 5, "Author", 0.9)],
                                  "query_id long, node_id string, node_ord int, label string, score double")
    top = ranking.rank_nodes(nodes, 4)
    assert [r.node_id for r in top.orderBy("rank").collect()] == ["e", "d", "c", "b"]
    edges = spark.createDataFrame([(1, "a", "e", "EXTENDS", 0.1, 1), (1, "d", "e", "EXTENDS", 0.1, 2)], EDGES)
    assert [(r.src, r.dst) for r in ranking.ranked_edges(edges, top).collect()] == [("d", "e")]


RANKED = "query_id long, node_id string, rank int, label string, name string, title string, text string, year int, venue string"
FULL_EDGES = EDGES + ", evidence_text string, metric string, value string, dataset string, margin string"


def lines(df):
    return [r.line for r in df.orderBy("line_no").collect()]


def test_line_formats(spark):
    ranked = spark.createDataFrame([
        (1, "c", 1, "Claim", None, None, "It works", None, None), (1, "p", 2, "Paper", None, "Deep", None, 2020, "NIPS"),
        (1, "q", 3, "Paper", None, "Bare", None, None, None), (1, "m", 4, "Method", "BERT", None, None, None, None),
        (1, "d", 5, "Dataset", "SQuAD", None, None, None, None), (1, "a", 6, "Author", "Ann", None, None, None, None),
        (1, "m2", 7, "Method", "GPT", None, None, None, None)], RANKED)
    e = [("p", "m", "INTRODUCES", "x", None, None, None, None), ("q", "m", "INTRODUCES", "x", None, None, None, None),
         ("p", "m", "USES_METHOD", "we use", None, None, None, None), ("m2", "m", "EXTENDS", None, None, None, None, None),
         ("p", "d", "EVALUATES_ON", "x", "F1", "93", None, None), ("q", "d", "EVALUATES_ON", "x", "F1", None, None, None),
         ("m2", "m", "OUTPERFORMS", "x", "F1", None, "SQuAD", "2.1"), ("p", "c", "REPORTS_RESULT", "It works", None, None, None, None),
         ("p", "a", "AUTHORED_BY", None, None, None, None, None)]
    edges = spark.createDataFrame([(1, s, t, k, 0.5, i, ev, me, va, da, ma) for i, (s, t, k, ev, me, va, da, ma) in enumerate(e)], FULL_EDGES)
    assert lines(ctx.entity_lines(ranked, edges)) == [
        "- [METHOD] BERT (introduced by Paper: 'Bare')", "- [METHOD] GPT", "- [DATASET] SQuAD", "- [PAPER] 'Deep' (2020, NIPS)",
        "- [PAPER] 'Bare'", "- [AUTHOR] Ann", "- [CLAIM] It works"]
    assert lines(ctx.relationship_lines(ranked, edges)) == [
        "- 'Deep' USES_METHOD BERT (evidence: \"we use\")", "- GPT EXTENDS BERT", "- 'Deep' EVALUATES_ON SQuAD (F1: 93)",
        "- 'Bare' EVALUATES_ON SQuAD", "- GPT OUTPERFORMS BERT on SQuAD (F1 margin: 2.1)", "- 'Deep' REPORTS_RESULT: It works"]


def context(spark, entities, relations, chunks, max_tokens, reserve):
    def part(rows):
        return spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(rows)], "query_id long, line_no int, line string")

    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    return {r.query_id: r for r in ctx.build_context(queries, part(entities), part(relations), part(chunks), max_tokens, reserve).collect()}


def simulate(entities, relations, chunks, max_tokens, reserve):
    import re

    def n(s):
        return len(re.findall(r"\w+|[^\w\s]", s))

    e, r, cut = list(entities), list(relations), False
    while n("\n".join(e) + " " + "\n".join(r)) > max_tokens - reserve and (e or r):
        cut = True
        (r or e).pop()
    blocks = (["ENTITIES:\n" + "\n".join(e)] if e else []) + (["RELATIONSHIPS:\n" + "\n".join(r)] if r else [])
    kept = []
    for c in chunks:
        text = "\n\n".join([*blocks, "RELEVANT TEXT CHUNKS:\n" + "\n".join([*kept, c])])
        if n(text) > max_tokens:
            cut = True
            break
        kept.append(c)
    text = "\n\n".join(blocks + (["RELEVANT TEXT CHUNKS:\n" + "\n".join(kept)] if kept else []))
    return text, n(text), cut


def test_context_budget_equals_step_by_step_trimming(spark):
    entities = [f"- [METHOD] name {i} of it" for i in range(6)]
    relations = [f"- a{i} EXTENDS b{i}" for i in range(5)]
    chunks = [f"- [intro] words and more words {i}" for i in range(4)]
    for budget, reserve in ((200, 20), (90, 20), (60, 20), (40, 30), (22, 20), (8, 8), (110, 5)):
        got = context(spark, entities, relations, chunks, budget, reserve)[1]
        assert (got.text, got.token_count, got.truncated) == simulate(entities, relations, chunks, budget, reserve), (budget, reserve)


def test_context_of_query_without_finds_is_empty(spark):
    got = context(spark, ["- x"], [], [], 100, 10)[2]
    assert (got.text, got.token_count, got.truncated) == ("", 0, False)


def test_citations_rank_order_then_chunk_papers(spark):
    ranked = spark.createDataFrame([(1, 1, "Method", None, "m", None), (1, 2, "Paper", "P2", "Two", 2019)],
                                   "query_id long, rank int, label string, paper_id string, title string, year int")
    chunks = spark.createDataFrame([(1, "P2", "s", "t", 0.9, 1), (1, "P1", "s", "t", 0.8, 2), (1, "P9", "s", "t", 0.7, 3)], CHUNKS)
    papers = spark.createDataFrame([("P1", "One"), ("P2", "Two")], "paper_id string, title string")
    rows = ctx.citations(ranked, chunks, papers).orderBy("ord").collect()
    assert [(r.paper_id, r.title, r.year) for r in rows] == [("P2", "Two", 2019), ("P1", "One", None), ("P9", None, None)]


def test_baseline_context(spark):
    chunks = spark.createDataFrame([(1, "P", "intro", "b", 0.9, 2), (1, "Q", None, "a", 0.8, 1)], CHUNKS)
    assert ctx.baseline_context(chunks).select(F.col("text")).first()[0] == "[1] (paper_id=Q, section=) a\n\n[2] (paper_id=P, section=intro) b"
