"""The stored search index against scoring every node."""

import collections
import random

import pyarrow as pa
import pytest

from citeloom.operators import search_index
from citeloom.operators.search import search
from citeloom.operators.search_index import BLOCK, INDEX_TABLES, _cut, index_texts, search_stored, unindex
from citeloom.sources.snapshots import Snapshots
from tests.test_search_sources_streams import bm25

TEXTS = "node_id string, label string, text string"
QUERIES = [(0, "the of"), (1, "the deep net"), (2, "of bert x1"), (3, "unseen"), (4, "x2 x3 x4 the data graph"), (5, "bert"), (6, "the"), (7, "")]


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "index"), INDEX_TABLES, buckets=8)


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["the"] * 12 + ["of"] * 6 + ["net", "deep", "graph", "bert", "data", "x1", "x2", "x3", "x4"]
    return [(f"n{i:04}", rng.choice(["Paper", "Method"]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]


def hits(store, spark, limit, within=None):
    got = collections.defaultdict(list)
    asked = spark.createDataFrame(QUERIES, "query_id int, text string")
    for r in search_stored(store, asked, limit, within=within).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.node_id)
    return got


def test_batches_replace_and_remove_what_is_indexed(spark, store):
    texts = random_texts(5, 900)
    first = [(i, label, text[::-1]) for i, label, text in texts[:500]]
    for batch in (first, texts[300:], texts[:300]):
        store.change(lambda c: index_texts(c, spark.createDataFrame(batch, TEXTS)))
    gone = {i for i, _, _ in texts[::7]}
    store.change(lambda c: unindex(c, spark.createDataFrame([(g,) for g in sorted(gone)], "node_id string")))
    left = [t for t in texts if t[0] not in gone]
    assert store.read("lengths").count() == len(left)
    allowed = {f"n{i:04}" for i in range(0, 900, 3)}
    within = spark.createDataFrame([(a,) for a in sorted(allowed)], "node_id string")
    for limit, keep, frame in ((3, None, None), (10, allowed, within)):
        got = hits(store, spark, limit, frame)
        for q, text in QUERIES:
            assert got[q] == bm25(left, text, limit, keep), (q, limit)


def test_scores_are_those_of_the_search_without_an_index(spark, store):
    frame = spark.createDataFrame(random_texts(6, 300), TEXTS)
    store.change(lambda c: index_texts(c, frame))
    asked = spark.createDataFrame(QUERIES, "query_id int, text string")
    for labels in (None, ["Method"]):
        assert sorted(map(tuple, search_stored(store, asked, 5, labels).collect())) == sorted(map(tuple, search(frame, asked, 5, labels).collect()))
    with pytest.raises(ValueError, match="unknown entity type"):
        search_stored(store, asked, labels=["Planet"])


def test_a_batch_leaves_other_shards_alone(spark, store):
    store.change(lambda c: index_texts(c, spark.createDataFrame(random_texts(7, 400), TEXTS)))
    before = store.layout()["blocks"]
    store.change(lambda c: index_texts(c, spark.createDataFrame([("n0003", "Paper", "moved")], TEXTS)))
    after = store.layout()["blocks"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_blocks_of_a_word_in_every_text_stay_small_and_empty_input_is_allowed(spark, store):
    assert hits(store, spark, 3) == {}
    store.change(lambda c: index_texts(c, spark.createDataFrame([], TEXTS)))
    rows = spark.range(40_000).selectExpr("concat('n', id) AS node_id", "'Paper' AS label", "IF(id = 7, 'the rare', IF(id % 5 = 0, null, 'the')) AS text")
    store.change(lambda c: index_texts(c, rows))
    blocks = store.read("blocks").filter("term = 'the'")
    assert blocks.agg({"held": "max"}).first()[0] < 2 * BLOCK and blocks.agg({"held": "sum"}).first()[0] == 32_000
    found = search_stored(store, spark.createDataFrame([(1, "the rare")], "query_id int, text string"), 1).collect()
    assert [r.node_id for r in found] == ["n7"]


def test_blocks_are_cut_while_sorted_postings_pass_by():
    rows = [(s, "Paper", w, 7, f"{w}{s}{i}", i % 5 + 1, i % 9 + 3) for w, s, n in (("a", 0, 300), ("a", 1, 1), ("b", 0, 128), ("c", 0, 129)) for i in range(n)]
    table = pa.table(dict(zip(("shard", "label", "term", "level", "node_id", "tf", "n_words"), map(list, zip(*rows)))))
    for size in (7, 128, 1000):
        blocks = [b for batch in _cut(table.to_batches(max_chunksize=size)) for b in batch.to_pylist()]
        assert [(b["term"], b["shard"], b["held"]) for b in blocks] == [
            ("a", 0, 128), ("a", 0, 128), ("a", 0, 44), ("a", 1, 1), ("b", 0, 128), ("c", 0, 128), ("c", 0, 1)]
        assert [(b["shard"], b["term"], *p.values()) for b in blocks for p in b["postings"]] == [(r[0], r[2], *r[4:]) for r in rows]
        assert all(b["held"] == len(b["postings"]) for b in blocks)
        assert all((b["top_tf"], b["low_words"]) == (max(p["tf"] for p in b["postings"]), min(p["n_words"] for p in b["postings"])) for b in blocks)
    assert list(_cut(iter([]))) == [] == list(_cut(table.slice(0, 0).to_batches()))


def test_a_node_is_named_once_whatever_its_words_are_and_no_posting_is_shuffled(spark, store):
    rng = random.Random(9)
    rows = [(f"{rng.getrandbits(512):0128x}", "Paper", " ".join(rng.sample(["net", "deep", *(f"w{i}" for i in range(60))], 30))) for _ in range(1500)]
    store.change(lambda c: index_texts(c, spark.createDataFrame(rows, TEXTS)))
    assert store.read("blocks").agg({"held": "sum"}).first()[0] == 45_000
    assert store.read("blocks").schema["postings"].dataType.elementType.names == ["number", "tf", "n_words"]
    assert store.read("lengths").select("shard", "number").distinct().count() == store.read("lengths").count() == 1500
    plan = search_index._inverted(store.read("lengths"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for limit in (3, 1000):
        assert hits(store, spark, limit)[1] == bm25(rows, "the deep net", limit)


def test_words_are_counted_while_nodes_pass_by(monkeypatch):
    rng = random.Random(3)
    nodes = [(rng.randrange(4), rng.choice(["Paper", "Method", None]), 7 if n in (50, 51) else n, sorted(rng.choices("abcdefgh", k=rng.randint(1, 90)))) for n in range(120)]
    nodes[50], nodes[51] = (0, *nodes[50][1:]), (1, *nodes[51][1:])  # numbers of two shards may agree
    rows = [(s, label, n, len(words), w) for s, label, n, words in nodes for w in words]
    table = pa.table(dict(zip(("shard", "label", "number", "n_words", "term"), map(list, zip(*rows)))))
    table = table.set_column(2, "number", table["number"].cast(pa.int64()))
    for size, most in ((7, 50), (13, 1), (10_000, 100), (500, 10_000)):
        monkeypatch.setattr(search_index, "PASS", most)
        got = [b for batch in search_index._alike_together(table.to_batches(max_chunksize=size)) for b in batch.to_pylist()]
        found = collections.Counter((g["shard"], g["label"], g["node_id"], g["n_words"], g["term"], g["tf"]) for g in got)
        assert found == collections.Counter((s, label, n, len(words), w, c) for s, label, n, words in nodes for w, c in collections.Counter(words).items())
        assert all(g["level"] == int(16 * g["tf"] / (g["tf"] + 1.2 * (0.25 + 0.75 * g["n_words"] / 64))) for g in got)
    blocks = [b for batch in _cut(iter(search_index._alike_together(table.to_batches()))) for b in batch.to_pylist()]
    groups = {(b["shard"], b["label"], b["term"]) for b in blocks if b["label"]}
    assert sum(b["held"] for b in blocks) == len(got) and len(groups) < len([b for b in blocks if b["label"]]) <= 16 * len(groups)
    assert list(search_index._alike_together(iter([]))) == []
