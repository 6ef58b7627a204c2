import random
from collections import Counter

from pyspark.sql import functions as F

from citeloom.operators import browse, compare, evals, merge
from citeloom.runtime import counted


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_node_merge_last_write_per_property(spark):
    changes = spark.createDataFrame([
        ("BERT", 1, ["d", "c"], "old", "x"), ("BERT", 2, ["c"], "ignored", "y"), ("BERT", 3, ["c"], None, None), ("GPT", 1, ["d"], "g", None)],
        "key string, seq int, passed array<string>, d string, c string")
    assert rows(merge.merge_nodes(changes, ["key"], ["d", "c"]), "key", "d", "c") == [("BERT", "old", None), ("GPT", "g", None)]


REL = "src string, dst string, rel_type string, seq int, confidence double"


def test_edge_merge_is_first_write_and_counts(spark):
    new = spark.createDataFrame([("a", "b", "EXTENDS", 1, 0.8), ("a", "b", "EXTENDS", 2, 0.9), ("a", "c", "EXTENDS", 3, 0.5)], REL)
    once = merge.first_write(new, ["confidence"])
    assert rows(once, "dst", "confidence", "occurrence_count") == [("b", 0.8, 2), ("c", 0.5, 1)]
    again = merge.merge_edges(once, spark.createDataFrame([("a", "b", "EXTENDS", 1, 0.1), ("x", "y", "EXTENDS", 1, None)], REL), ["confidence"])
    assert rows(again.na.fill(-1.0), "dst", "confidence", "occurrence_count") == [("b", 0.8, 3), ("c", 0.5, 1), ("y", -1.0, 1)]


def test_collapse_adds_copies_not_their_counts(spark):
    edges = spark.createDataFrame([("a", "b", "T", 5, 1), ("a", "b", "T", 9, 2), ("a", "b", "T", None, 3), ("a", "c", "T", None, 4)],
                                  "src string, dst string, rel_type string, occurrence_count int, id int")
    assert sorted((r.dst, r.id, r.occurrence_count) for r in merge.collapse_duplicate_edges(edges, [F.col("id")]).collect()) == [("b", 2, 11), ("c", 4, None)]
    assert rows(merge.duplicate_edge_preview(edges), "rel_type", "duplicate_groups", "extra_edges") == [("T", 1, 2)]


def test_delete_cascade(spark):
    nodes = spark.createDataFrame([("P1", "Paper", "1"), ("P2", "Paper", "2"), ("shared", "Method", None), ("own", "Claim", None), ("kept", "Method", None), ("apart", "Method", None)],
                                  "node_id string, label string, paper_id string")
    edges = spark.createDataFrame([("P1", "shared"), ("P2", "shared"), ("P1", "own"), ("P1", "kept"), ("kept", "shared")], "src string, dst string")
    papers = spark.createDataFrame([("1",), ("2",)], "paper_id string")
    chunks = spark.createDataFrame([("1", "c1"), ("2", "c2")], "paper_id string, chunk_id string")
    vectors = spark.createDataFrame([("shared",), ("own",), ("kept",)], "node_id string")
    pairs = spark.createDataFrame([("shared", "1"), ("shared", "2"), ("own", "1"), ("kept", "1")], "node_id string, paper_id string")
    out = merge.delete_papers(papers, nodes, edges, chunks, vectors, pairs, spark.createDataFrame([("1",)], "paper_id string"))
    assert rows(out["nodes"], "node_id") == [("P2",), ("apart",), ("kept",), ("shared",)]
    assert rows(out["orphans"], "node_id") == [("own",)] and rows(out["papers"], "paper_id") == [("2",)]
    assert rows(out["edges"], "src", "dst") == [("P2", "shared"), ("kept", "shared")] and rows(out["chunks"], "chunk_id") == [("c2",)]
    assert rows(out["entity_vectors"], "node_id") == [("kept",), ("shared",)] and rows(out["entity_papers"], "node_id", "paper_id") == [("shared", "2")]


def test_orphans_equal_a_plain_search(spark):
    draw = random.Random(5)
    label = {f"n{i}": draw.choice(["Paper", "Method", "Claim"]) for i in range(60)}
    pairs = [(draw.choice(sorted(label)), draw.choice(sorted(label))) for _ in range(70)] + [("n1", "n1"), (None, "n2"), ("n3", None), ("n4", "unknown")]
    gone = {n for n in label if label[n] == "Paper" and draw.random() < 0.7}
    far = {n: [b if a == n else a for a, b in pairs if n in (a, b)] for n in label}
    want = {n for n in label if label[n] != "Paper" and far[n] and all(o in gone for o in far[n])}
    nodes = spark.createDataFrame([(n, label[n], n) for n in label], "node_id string, label string, paper_id string")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    doomed = spark.createDataFrame([(n,) for n in gone], "paper_id string")
    none = spark.createDataFrame([], "node_id string, paper_id string")
    out = merge.delete_papers(nodes.select("paper_id"), nodes, edges, none, none, none, doomed)
    assert want and {r.node_id for r in out["orphans"].collect()} == want
    assert {r.node_id for r in out["nodes"].collect()} == set(label) - gone - want
    # what is left of nodes and provenance joins the ids that go, and no edge a second time
    assert all("src" not in out[t]._jdf.queryExecution().optimizedPlan().toString() for t in ("nodes", "entity_papers"))


def test_patch_only_sent_fields(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, note string")
    changes = spark.createDataFrame([(1, None, "n", ["name"])], "id int, name string, note string, sent array<string>")
    assert sorted((r.id, r.name, r.note) for r in merge.patch(stored, changes, "id", ["name", "note"]).collect()) == [(1, None, "x"), (2, "b", "y")]


def test_payload_patch_is_shallow(spark):
    stored = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None)], "id int, payload map<string,string>")
    changes = spark.createDataFrame([(1, {"b": "3", "c": "4"}), (2, {"z": "9"})], "id int, payload map<string,string>")
    assert {r.id: r.payload for r in merge.patch_payload(stored, changes, "id").collect()} == {1: {"a": "1", "b": "3", "c": "4"}, 2: {"z": "9"}}


def test_claim_key_ignores_case_and_blanks(spark):
    claims = spark.createDataFrame([("p", "It Works", "RESULT", 0.5, 1), ("p", "it  works ", "RESULT", 0.9, 2), ("q", "it works", "RESULT", 0.5, 3)],
                                   "paper_id string, text string, claim_type string, confidence double, seq int")
    out = merge.claim_nodes(claims, F.col("seq"))
    assert rows(out, "paper_id", "text", "confidence") == [("p", "it  works ", 0.9), ("q", "it works", 0.5)]


def test_remap_and_mismatches(spark):
    nodes = spark.createDataFrame([("1", "A"), ("2", "B")], "node_id string, label string")
    edges = spark.createDataFrame([("1", "2", "T")], "src string, dst string, rel_type string")
    ids = spark.createDataFrame([("1", "x"), ("2", "y")], "old_id string, new_id string")
    n, e = merge.remap_graph(nodes, edges, ids)
    assert rows(n, "node_id", "label") == [("x", "A"), ("y", "B")] and rows(e, "src", "dst", "rel_type") == [("x", "y", "T")]
    assert merge.count_mismatches(nodes, n, "label").count() == 0 and merge.row_mismatches(nodes, n).count() == 4


def test_usage_counts_absent_versus_zero(spark):
    nodes = spark.createDataFrame([("p", "Paper"), ("alone", "Paper"), ("m", "Method"), ("idle", "Method"), ("k", "Claim")], "node_id string, label string")
    edges = spark.createDataFrame([("p", "m", "USES_METHOD"), ("p", "idle", "INTRODUCES"), ("m", "m", "EXTENDS")], "src string, dst string, rel_type string")
    assert rows(browse.usage_counts(nodes, edges), "node_id", "usage_count") == [("alone", 0), ("m", 1), ("p", 2)]
    detail = {r.node_id: r.usage_count for r in browse.entity_usage(nodes, edges).collect()}
    assert detail == {"p": 2, "alone": 0, "m": 1, "idle": 0, "k": None}


def test_self_loop_shows_once(spark):
    edges = spark.createDataFrame([("a", "a", "T"), ("a", "b", "T")], "src string, dst string, rel_type string")
    assert rows(browse.oriented(edges), "node_id", "other_id", "direction") == [("a", "a", "outgoing"), ("a", "b", "outgoing"), ("b", "a", "incoming")]


def test_rows_per_key_are_combined_by_batch_and_dealt(spark):
    keys = [None if i % 50 == 0 else "hub" if i % 3 else f"k{i % 11}" for i in range(3000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "node_id string, other long").repartition(5)
    out = counted(df, "node_id")
    shuffled = out._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert {r.node_id: r.n for r in out.collect()} == dict(Counter(keys)) and out.schema["n"].dataType.typeName() == "long"
    # no input task keeps a map of the keys it reads: all aggregation is behind the one shuffle
    assert len(shuffled) == 2 and "Aggregate" not in shuffled[1] and counted(df.limit(0), "node_id").count() == 0


def slot(key):
    h = 5381
    for ch in key:
        low = (h * 33) & 0xFFFFFFFF
        h = (low - (1 << 32) if low >= 1 << 31 else low) ^ ord(ch)
    return abs(h) % 8


def test_palette_slot_equals_direct_loop(spark):
    keys = ["", "a", "c0ffee00-1234-4abc-8def-000000000001", "p:17", "zzzzzzzzzzzzzzzzzzzz"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(browse.palette_slot(F.col("k"))).collect()]
    assert got == [slot(k) for k in keys]


def test_display_helpers(spark):
    df = spark.createDataFrame([("Claim", 9), ("Method", None), ("Method", 4), ("Paper", 1000)], "label string, n int")
    got = df.select(browse.node_size(F.col("label"), F.col("n")), browse.node_size(F.col("label"), F.col("n"), True)).collect()
    assert [tuple(r) for r in got] == [(30, 18), (24, 14), (44, 26), (70, 40)]
    e = spark.createDataFrame([("OUTPERFORMS", None, None, "2"), ("OUTPERFORMS", None, None, None), ("EVALUATES_ON", "F1", None, None), ("USES_METHOD", None, None, None)],
                              "t string, metric string, value string, margin string")
    assert [r[0] for r in e.select(browse.edge_label(F.col("t"), F.col("metric"), F.col("value"), F.col("margin"))).collect()] == ["outperforms 2", "outperforms", "F1", ""]


def test_recall_and_summary(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "question_id int")
    s = spark.createDataFrame([(1, "T5 Paper (T5)"), (1, "Other"), (1, "Other"), (2, "X")], "question_id int, title string")
    c = spark.createDataFrame([(1, "t5 paper"), (1, "T5 Paper"), (2, "Y")], "question_id int, title string")
    assert rows(evals.recall(q, s, c), "question_id", "recall") == [(1, 1 / 3), (2, 0.0), (3, 1.0)]
    r = spark.createDataFrame([(1, "a", 1.0, 1.0, 0.0, 0.5, 10), (2, "a", 0.5, 0.0, 1.0, 0.5, 20), (3, "b", 0.0, 0.0, 0.0, 0.0, 33)],
                              "id int, category string, graph_score double, graph_recall double, plain_score double, plain_recall double, latency_ms int")
    got = {x.category: (x.n, x.graph_score, x.latency_ms) for x in evals.summarise(r).collect()}
    assert got == {None: (3, 0.5, 21.0), "a": (2, 0.75, 15.0), "b": (1, 0.0, 33.0)}
    assert [x.id for x in evals.wins(r, "id").collect()] == [1]
    assert evals.report(evals.summarise(r)).count() == 3


def test_compare_latency_and_votes(spark):
    q = spark.createDataFrame([(1, "why")], "query_id int, question string")
    side = lambda a, ms: spark.createDataFrame([(1, a, ms)], "query_id int, answer string, latency_ms int")
    log = compare.log_rows(compare.compare(q, side("g", 40), side("v", 70)), F.current_timestamp())
    row = log.first()
    assert (row.graphrag_answer, row.vanilla_answer, row.latency_ms, row.compare_verdict) == ("g", "v", 70, None)
    votes = spark.createDataFrame([(row.query_log_id, "vanilla", 1), (row.query_log_id, "graphrag", 2), (row.query_log_id, "bogus", 3)], "query_log_id string, verdict string, seq int")
    assert compare.vote(log, votes).first().compare_verdict == "graphrag"
