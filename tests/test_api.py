import pytest
from pyspark.sql import functions as F

from citeloom import api
from citeloom.operators.retrieve import Corpus
from citeloom.schema import EDGES, NODES

DIM = 16


@pytest.fixture(scope="module")
def corpus(spark):
    def rows(schema, *dicts):
        return spark.createDataFrame([tuple(d.get(f.name) for f in schema.fields) for d in dicts], schema)

    nodes = rows(
        NODES, *[{"node_id": f"P{i}", "label": "Paper", "paper_id": str(i), "title": f"Title {i}", "collection_id": c, "year": 2000 + i} for i, c in ((1, "A"), (2, "B"), (3, None))],
        {"node_id": "m", "label": "Method", "name": "DeepNet"}, {"node_id": "d", "label": "Dataset", "name": "FooQA"}, {"node_id": "lone", "label": "Method", "name": "Alone"},
        {"node_id": "k", "label": "Claim", "text": "DeepNet wins", "source_paper_id": "1"})
    edges = rows(EDGES, *[{"src": s, "dst": t, "rel_type": k, "confidence": c, "evidence_text": "as shown", "metric": "F1", "value": "9", "occurrence_count": 1} for s, t, k, c in
                          (("P1", "m", "USES_METHOD", 0.9), ("P2", "m", "USES_METHOD", 0.8), ("P2", "d", "EVALUATES_ON", 0.7), ("P1", "k", "REPORTS_RESULT", 0.6), ("P3", "d", "EVALUATES_ON", 0.5))])
    vec = lambda df, text: df.withColumn("vector", api.embed(F.col(text), DIM))
    chunks = vec(spark.createDataFrame([(1, "1", "A", "intro", "deep nets are good", 1), (2, "2", "B", "method", "quite other words here", 2)],
                                       "chunk_id long, paper_id string, collection_id string, section_name string, text string, page_number int"), "text")
    entities = vec(nodes.filter("label = 'Method'").select("node_id", "name"), "name").drop("name")
    pairs = spark.createDataFrame([("m", "1"), ("m", "2")], "node_id string, paper_id string")
    papers = nodes.filter("label = 'Paper'").select("paper_id", "title", "collection_id", F.col("year").alias("created_at"))
    return Corpus(nodes, edges, entities, pairs, chunks, papers, DIM)


@pytest.fixture
def provider():
    def make():
        return lambda system, prompt: '{"score": 0.1}' if prompt.startswith("CONTEXT") else f"answer of {len(prompt)} characters"

    return make


def test_query_and_baseline_and_compare(spark, corpus, provider):
    asked = api.with_vectors(spark.createDataFrame([(1, "deep nets", None), (2, "deep nets", "A")], "query_id long, question string, collection_id string"), DIM)
    out = api.query(corpus, asked, [provider], pause=0)
    answers = {r.query_id: r for r in out["answers"].collect()}
    assert answers[1].answer.startswith("answer of") and answers[1].warning is not None
    assert {r.paper_id for r in out["citations"].filter("query_id = 2").collect()} == {"1"}
    stats = {r.query_id: r for r in out["stats"].collect()}
    assert stats[2].graph_nodes == 3 and stats[1].graph_nodes == 6 and stats[1].context_tokens > 10
    assert {r.node_id for r in out["nodes"].filter("query_id = 2").collect()} == {"P1", "m", "k"}
    plain = api.query_vanilla(corpus, asked, [provider], pause=0)
    assert plain["sources"].filter("query_id = 2").select("paper_title", "page_number").first() == ("Title 1", 1)
    log = api.query_compare(corpus, asked, [provider], pause=0)
    assert log.count() == 2 and set(log.columns) >= {"graphrag_answer", "vanilla_answer", "query_log_id"}


def test_empty_finds_give_fixed_replies(spark, corpus, provider):
    asked = api.with_vectors(spark.createDataFrame([(1, "x", "none such")], "query_id long, question string, collection_id string"), DIM)
    assert api.query_vanilla(corpus, asked, [provider], pause=0)["answers"].first().answer == api.NO_EXCERPTS


def test_overview_and_views(spark, corpus):
    n, e = api.graph_overview(corpus)
    assert {r.label: r.n for r in n.collect()} == {"Paper": 3, "Method": 2, "Dataset": 1, "Claim": 1, "(total)": 7}
    assert {r.rel_type: r.n for r in e.collect()}["(total)"] == 5
    n, e = api.graph_overview(corpus, "A")
    assert {r.label: r.n for r in n.collect()} == {"Paper": 1, "Method": 1, "Claim": 1, "(total)": 3}
    nodes, edges = api.graph_subgraph(corpus, "m", hops=1)
    assert {r.node_id: r.usage_count for r in nodes.collect()} == {"P1": 2, "P2": 2, "m": 2} and edges.count() == 2
    assert api.graph_subgraph(corpus, "nobody")[0].count() == 0
    nodes, edges = api.graph_subgraph(corpus)
    assert nodes.count() == 7 and edges.count() == 5 and {r.usage_count for r in nodes.filter("node_id = 'lone'").collect()} == {None}


def test_entity_detail_scoping(corpus):
    node, related = api.graph_entity(corpus, "m")
    assert node.first().usage_count == 2 and {r.other_id for r in related.collect()} == {"P1", "P2"}
    assert {r.other_id for r in api.graph_entity(corpus, "m", "A")[1].collect()} == {"P1"}
    assert api.graph_entity(corpus, "lone")[0].first().usage_count == 0
    assert api.graph_entity(corpus, "k")[0].first().usage_count is None and api.graph_entity(corpus, "zzz")[0].count() == 0


def test_search_papers_and_deletes(spark, corpus):
    hits = api.graph_search(corpus, spark.createDataFrame([(1, "deepnet")], "query_id long, text string"))
    assert {(r.node_id, r.name) for r in hits.collect()} == {("m", "DeepNet"), ("k", "DeepNet wins")}
    assert api.graph_search(corpus, spark.createDataFrame([(1, "title")], "query_id long, text string"), "Paper", collection="B").first().node_id == "P2"
    assert {(r.entity_id, r.from_paper) for r in api.paper_detail(corpus, "1")[1].collect()} == {("m", True), ("k", True)}
    assert [r.paper_id for r in api.paper_list(corpus.papers).collect()] == ["3", "2", "1"]
    left = api.paper_delete(corpus, spark.createDataFrame([("1",)], "paper_id string"))
    assert {r.node_id for r in left["orphans"].collect()} == {"k"}


def test_export_and_dump(spark, corpus, tmp_path):
    api.graph_export(corpus, str(tmp_path / "export"))
    assert spark.read.text(str(tmp_path / "export")).groupBy("kind").count().collect().__len__() == 2
    api.dump(corpus, str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump" / "edges")).count() == 5
