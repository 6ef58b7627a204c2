import random

import pytest

from citeloom.operators import traverse as tr
from citeloom.operators.merge import EDGE_KEY

EDGES = "query_id long, src string, dst string, rel_type string, conf double, ord int"


def random_graph(seed, n=9, m=16):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["EXTENDS", "USES_METHOD", "OUTPERFORMS"])) for _ in range(m)})


def trails(edges, seeds, hops):
    """All edges on trails (no edge twice) of up to ``hops`` steps from a seed."""
    met = set()

    def walk(node, used):
        if len(used) == hops:
            return
        for i, (a, b, _) in enumerate(edges):
            if i not in used and node in (a, b):
                met.update(used | {i})
                walk(b if node == a else a, used | {i})

    for s in seeds:
        walk(s, frozenset())
    return {edges[i] for i in met}


def test_traversal_equals_trail_enumeration(spark):
    rows, seeds, want = [], [], {}
    for q in range(12):
        g = random_graph(q)
        rows += [(f"{q}{a}", f"{q}{b}", t, None if i % 4 == 0 else round(i / 20, 2)) for i, (a, b, t) in enumerate(g)]
        for s in ("n0", "n3"):
            seeds.append((q, f"{q}{s}"))
        want[q] = g
    edges = spark.createDataFrame(rows, "src string, dst string, rel_type string, confidence double")
    seed_df = spark.createDataFrame(seeds, "query_id long, node_id string")
    for hops in (1, 2, 3):
        got = {}
        for r in tr.traverse(edges, seed_df, hops, salts=3).collect():
            got.setdefault(r.query_id, set()).add((r.src, r.dst, r.rel_type))
        for q, g in want.items():
            expected = {(f"{q}{a}", f"{q}{b}", t) for a, b, t in trails(g, ["n0", "n3"], hops)}
            assert got.get(q, set()) == expected, (q, hops)


def test_a_stored_adjacency_gives_the_same_edges_and_is_never_shuffled(spark, tmp_path):
    rows = [(f"{q}{a}", f"{q}{b}", t, 0.5) for q in range(6) for a, b, t in random_graph(q)]
    edges = spark.createDataFrame(rows, "src string, dst string, rel_type string, confidence double")
    seeds = spark.createDataFrame([(q, f"{q}n0") for q in range(6)], "query_id long, node_id string")
    links = tr.store_two_way(edges, "links_of_a_test", str(tmp_path / "links"), buckets=4)
    for kinds in (None, ["EXTENDS", "OUTPERFORMS"]):
        plain, stored = (sorted(map(tuple, tr.traverse(edges, seeds, 3, kinds, links=x).collect())) for x in (None, links))
        assert plain == stored and plain
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tr.incident(links, seeds)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE links_of_a_test")
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan


def test_a_limit_is_cut_in_every_task_whatever_the_settings(spark):
    rng = random.Random(4)
    rows = [(f"q{rng.randrange(3)}", f"s{rng.randrange(400):03}", f"d{i}", "EXTENDS", rng.choice([0.0, 0.5, 0.9, 0.9, float("nan")] if i % 50 == 0 else [0.0, 0.5, 0.9]))
            for i in range(130_000)]
    met = spark.createDataFrame(rows, "query_id string, src string, dst string, rel_type string, conf double").coalesce(1)
    got = [tuple(r) for r in tr.best_of_tasks(met, 40).collect()]
    nan = [r for r in rows if r[4] != r[4]]
    assert len([r for r in got if r[4] != r[4]]) == len(nan)
    for q in ("q0", "q1", "q2"):
        own = sorted((r for r in rows if r[0] == q and r[4] == r[4]), key=lambda r: (-r[4], *r[1:4]))
        assert sorted((r for r in got if r[0] == q and r[4] == r[4]), key=lambda r: (-r[4], *r[1:4])) == own[:40]
    assert tr.best_of_tasks(met.limit(0), 40).count() == 0


def test_an_adjacency_row_names_each_node_once(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "EXTENDS", 0.5), ("c", "c", "EXTENDS", None)], "src string, dst string, rel_type string, confidence double")
    links = tr.store_two_way(edges, "narrow_links_of_a_test", str(tmp_path / "narrow"), buckets=2)
    try:
        assert sorted(map(tuple, links.collect())) == [("a", "b", True, "EXTENDS", 0.5), ("b", "a", False, "EXTENDS", 0.5), ("c", "c", True, "EXTENDS", 0.0)]
    finally:
        spark.sql("DROP TABLE narrow_links_of_a_test")


def test_limits_are_filled_from_the_best_edges_of_all(spark, monkeypatch):
    rng = random.Random(11)
    ids = [f"n{i:02}" for i in range(40)]
    rows = sorted({(rng.choice(ids), rng.choice(ids), rng.choice(["EXTENDS", "USES_METHOD"])): rng.choice([0.2, 0.5, 0.5, 0.9, None, float("nan")]) for _ in range(160)}.items())
    rows = [(*key, conf) for key, conf in rows] + [("far", "away", "EXTENDS", 0.1), (None, "n01", "EXTENDS", 0.9), ("n02", None, "EXTENDS", 0.9)]
    edges = spark.createDataFrame(rows, "src string, dst string, rel_type string, confidence double").repartition(3)
    seeds = spark.createDataFrame([(q, s) for q in range(3) for s in ids[q::3]] + [(3, "far"), (4, "nowhere"), (5, ids[0])], "query_id long, node_id string")
    for hops, limit, ahead, kinds in ((1, 6, 4, None), (2, 9, 2, ["EXTENDS"]), (3, 20, 8, None), (3, 200, 8, None)):
        plain = sorted(map(repr, tr.traverse(edges, seeds, hops, kinds, limit).collect()))
        with monkeypatch.context() as patched:
            patched.setattr(tr, "BROADCAST_ROWS", 0)
            patched.setattr(tr, "AHEAD", ahead)
            assert sorted(map(repr, tr.traverse(edges, seeds, hops, kinds, limit).collect())) == plain, (hops, limit)


def test_edges_are_not_joined_for_queries_that_the_best_ones_fill(spark, monkeypatch):
    edges = spark.range(30_000).selectExpr("concat('n', id) AS src", "concat('h', id % 7) AS dst", "'EXTENDS' AS rel_type", "(id % 100) / 100 AS confidence")
    seeds = spark.range(30_000).selectExpr("id % 3 AS query_id", "concat('n', id) AS node_id")
    best = sorted((f"n{i}", f"h{i % 7}") for i in range(99, 30_000, 100))[:5]

    def never(links, reached):
        raise AssertionError("all edges that are met were joined")

    monkeypatch.setattr(tr, "incident", never)
    got = tr.traverse(edges, seeds, 2, row_limit=5).orderBy("query_id", "ord").collect()
    assert [(r.query_id, r.src, r.dst, r.ord) for r in got] == [(q, *e, i + 1) for q in range(3) for i, e in enumerate(best)]


def test_row_limit_keeps_best_confidence_per_query(spark):
    edges = spark.createDataFrame([("s", f"x{i}", "EXTENDS", i / 100) for i in range(50)] + [("s", "none", "EXTENDS", None)],
                                  "src string, dst string, rel_type string, confidence double")
    seeds = spark.createDataFrame([(1, "s"), (2, "x3")], "query_id long, node_id string")
    rows = tr.traverse(edges, seeds, 1, row_limit=5).orderBy("query_id", "ord").collect()
    assert [(r.query_id, r.dst, r.ord) for r in rows] == [(1, f"x{49 - i}", i + 1) for i in range(5)] + [(2, "x3", 1)]


def test_relation_types_outside_the_vocabulary_match_nothing(spark):
    edges = spark.createDataFrame([("a", "b", "EXTENDS", 0.5)], "src string, dst string, rel_type string, confidence double")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, node_id string")
    assert tr.traverse(edges, seeds, rel_types=["NOPE"]).count() == 0
    assert tr.traverse(edges, seeds, rel_types=["EXTENDS", "NOPE"]).count() == 1


def greedy(edges, budget):
    kept, taken = [], []
    for e in edges:
        fresh = [x for x in dict.fromkeys(e[:2]) if x not in kept]
        if not fresh or len(kept) + len(fresh) <= budget:
            kept += fresh
            taken.append(e)
    return kept, taken


def test_cap_equals_greedy_pass(spark):
    rng = random.Random(11)
    rows, want = [], {}
    budget = 7
    for q in range(40):
        names = [f"v{i}" for i in range(rng.choice([5, 9, 14]))]
        edges = list(dict.fromkeys((rng.choice(names), rng.choice(names), "EXTENDS") for _ in range(rng.randint(3, 25))))
        rows += [(q, *e, 1 - i / 100, i + 1) for i, e in enumerate(edges)]
        ends = {x for e in edges for x in e[:2]}
        want[q] = (list(dict.fromkeys(x for e in edges for x in e[:2])), edges) if len(ends) <= budget else greedy(edges, budget)
    df = spark.createDataFrame(rows, EDGES)
    nodes = tr.cap_nodes(df, tr.subgraph_nodes(df), budget)
    kept = {}
    for r in nodes.orderBy("query_id", "node_ord").collect():
        kept.setdefault(r.query_id, []).append(r.node_id)
    taken = {}
    for r in tr.keep_between(df, nodes.select("query_id", "node_id")).orderBy("query_id", "ord").collect():
        taken.setdefault(r.query_id, []).append((r.src, r.dst, r.rel_type))
    for q, (names, edges) in want.items():
        assert kept[q] == names and taken[q] == edges, q
        assert len(names) <= max(budget, 0) or len(names) <= budget


def test_cap_keeps_highest_confidence(spark):
    df = spark.createDataFrame([(1, "s", "hi", "EXTENDS", 0.9, 1), (1, "s", "mid", "EXTENDS", 0.5, 2), (1, "s", "lo", "EXTENDS", 0.1, 3)], EDGES)
    assert {r.node_id for r in tr.cap_nodes(df, tr.subgraph_nodes(df), 2).collect()} == {"s", "hi"}


def test_distances_are_multi_source_and_undirected(spark):
    df = spark.createDataFrame([(1, "a", "b", "EXTENDS", 0.1, 1), (1, "c", "b", "EXTENDS", 0.1, 2), (1, "c", "d", "EXTENDS", 0.1, 3),
                                (1, "x", "y", "EXTENDS", 0.1, 4), (2, "a", "a", "EXTENDS", 0.1, 1)], EDGES)
    seeds = spark.createDataFrame([(1, "a"), (1, "d"), (1, "lonely"), (2, "a")], "query_id long, node_id string")
    got = {(r.query_id, r.node_id): r.distance for r in tr.seed_distances(df, seeds).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 1, (1, "d"): 0, (2, "a"): 0}


NODES = "node_id string, label string, collection_id string, paper_id string, source_paper_id string"


@pytest.fixture(scope="module")
def scoped(spark):
    nodes = spark.createDataFrame([
        ("p1", "Paper", "A", "1", None), ("p2", "Paper", "B", "2", None), ("p3", "Paper", None, "3", None),
        ("m", "Method", None, None, None), ("x", "Method", None, None, None), ("y", "Method", None, None, None),
        ("k1", "Claim", None, None, "1"), ("k2", "Claim", None, None, "2"), ("z", "Dataset", None, None, None)], NODES)
    base = [("p1", "m"), ("p2", "m"), ("p1", "x"), ("p2", "y"), ("p1", "k1"), ("m", "k2"), ("p3", "z")]
    rows = [(q, a, b, "EXTENDS", 0.5, i + 1) for q in (1, 2) for i, (a, b) in enumerate(base)]
    rows += [(3, "p1", "x", "EXTENDS", 0.5, 1)]
    queries = spark.createDataFrame([(1, "A"), (2, None), (3, "A")], "query_id long, collection_id string")
    edges, kept = tr.scope_to_collection(spark.createDataFrame(rows, EDGES), nodes, queries)
    return ({q: {(r.src, r.dst) for r in edges.collect() if r.query_id == q} for q in (1, 2, 3)},
            {q: {r.node_id for r in kept.collect() if r.query_id == q} for q in (1, 2, 3)})


def test_scope_drops_foreign_untagged_and_orphaned(scoped):
    edges, nodes = scoped
    assert nodes[1] == {"p1", "m", "x", "k1"} and edges[1] == {("p1", "m"), ("p1", "x"), ("p1", "k1")}


def test_scope_leaves_unscoped_queries_alone(scoped):
    edges, nodes = scoped
    assert len(nodes[2]) == 9 and len(edges[2]) == 7 and nodes[3] == {"p1", "x"}


def test_in_scope_paper_survives_without_edges(spark):
    nodes = spark.createDataFrame([("p1", "Paper", "A", "1", None), ("p2", "Paper", "B", "2", None)], NODES)
    edges = spark.createDataFrame([(1, "p1", "p2", "EXTENDS", 0.5, 1)], EDGES)
    queries = spark.createDataFrame([(1, "A")], "query_id long, collection_id string")
    kept_edges, kept = tr.scope_to_collection(edges, nodes, queries)
    assert kept_edges.count() == 0 and [r.node_id for r in kept.collect()] == ["p1"]


def test_entity_types_spare_seeds(spark):
    nodes = spark.createDataFrame([("p", "Paper", None, "1", None), ("m", "Method", None, None, None), ("d", "Dataset", None, None, None)], NODES)
    edges = spark.createDataFrame([(1, "p", "m", "USES_METHOD", 0.5, 1), (1, "p", "d", "EVALUATES_ON", 0.5, 2)], EDGES)
    seeds = spark.createDataFrame([(1, "p")], "query_id long, node_id string")
    assert [(r.src, r.dst) for r in tr.filter_entity_types(edges, nodes, seeds, ["Method"]).collect()] == [("p", "m")]


def test_edge_key():
    assert tr.EDGE_KEY == EDGE_KEY
