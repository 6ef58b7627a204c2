"""One ingestion run: states, resumption, atomic commits."""

import json
import re

import pytest
from pyspark.sql import functions as F

from citeloom import api
from citeloom.operators.extract import ACROSS_TASK, ENTITY_TASK, WITHIN_TASK
from citeloom.operators.ingest import delete_papers, ingest_batch, open_store

PAPERS = "paper_id string, title string, authors array<string>, year int, venue string, abstract string, collection_id string, sections array<struct<ord:int,name:string,text:string>>"


def model(log, fail=None):
    """Reads methods (...Net) and datasets (...QA) out of a section, notes each call in a file, and fails on a task if asked to."""
    tasks = {ENTITY_TASK: "entities", WITHIN_TASK: "within", ACROSS_TASK: "across"}

    def build():
        def complete(system, prompt):
            with open(log, "a") as out:
                out.write(f"{tasks[system]}\n")
            if tasks[system] == fail:
                raise RuntimeError("out of order")
            text = prompt.rsplit("\n\n", 1)[1]
            nets, sets = (list(dict.fromkeys(re.findall(rf"\w+{x}", text))) for x in ("Net", "QA"))
            if system == ENTITY_TASK:
                return json.dumps({"methods": [{"name": m, "description": f"the {m} model", "category": "model", "confidence": 0.9} for m in nets],
                                   "datasets": [{"name": x, "domain": "questions", "confidence": 0.7} for x in sets],
                                   "claims": [{"text": text.split(".")[0] + ".", "type": "RESULT", "confidence": 0.8}]})
            if system == WITHIN_TASK:
                return json.dumps({"relations": [{"type": "USES_METHOD", "target": m, "evidence_text": "uses " + m, "confidence": 0.9} for m in nets]})
            return json.dumps({"relations": [{"type": "EXTENDS", "source": nets[0], "target": "FooNet", "confidence": 0.9}] if nets else []})

        return complete

    return [build]


def calls(log):
    lines = log.read_text().split() if log.exists() else []
    return {k: lines.count(k) for k in ("entities", "within", "across")}


def papers(spark, *ids):
    texts = {"1": "FooNet is good on FooQA. More text follows here.", "2": "BarNet is good on BarQA. It is new.", "3": "FooNet again beats BarNet on FooQA. Yes it does."}
    return spark.createDataFrame([(i, f"Paper {i}", ["Ann Lee"], 2020, "V", f"About {i}", "A", [(0, "method", texts[i])]) for i in ids], PAPERS)


def states(store):
    return {r.paper_id: r.status for r in store.read("jobs").collect()}


def graph(store, version=None):
    return {(r.src, r.dst, r.rel_type): r.occurrence_count for r in store.read("edges", version).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, str(tmp_path / "graph"), buckets=2)


def test_batches_of_papers_grow_one_graph(spark, store, tmp_path):
    log = tmp_path / "calls"
    ingest_batch(store, papers(spark, "1"), model(log), dimension=8, pause=0)
    first = store.version()
    assert states(store) == {"1": "completed"} and calls(log) == {"entities": 1, "within": 1, "across": 0}
    ingest_batch(store, papers(spark, "1", "2"), model(log), dimension=8, pause=0)
    assert states(store) == {"1": "completed", "2": "completed"} and calls(log)["entities"] == 2 and calls(log)["across"] == 1
    nodes = {r.node_id: r for r in store.read("nodes").collect()}
    foo, bar = nodes["new:Method:foonet"], nodes["new:Method:barnet"]
    assert (foo.category, foo.domain, foo.confidence, foo.description) == ("model", None, 0.9, "the FooNet model")
    assert nodes["new:Dataset:fooqa"].domain == "questions" and nodes["paper:1"].venue == "V"
    assert {r.claim_type for r in nodes.values() if r.label == "Claim"} == {"RESULT"}
    edges = graph(store)
    assert edges[("new:Method:barnet", "new:Method:foonet", "EXTENDS")] == 1 and edges[("paper:2", bar.node_id, "USES_METHOD")] == 1
    assert graph(store, first).items() <= edges.items()  # what the first commit wrote is as it was
    assert {r.paper_id for r in store.read("entity_papers").where(F.col("node_id") == bar.node_id).collect()} == {"2"}
    assert {r.node_id for r in store.read("entity_vectors").where(F.size("vector") == 8).collect()} == {k for k, r in nodes.items() if r.label != "Author"}
    assert {r.paper_id for r in store.read("chunks").collect()} == {"1", "2"} and store.read("units").isEmpty()
    job = store.read("jobs").where("paper_id = '2'").first()
    assert job.entities_found == 3 and job.relations_found > 0 and bar.label == "Method"

    def named(text):
        return {r.node_id for r in api.stored_search(store, spark.createDataFrame([(1, text)], "query_id int, text string")).collect()}

    assert {foo.node_id, bar.node_id} <= named("foonet barnet") and "paper:2" in named(nodes["paper:2"].title)

    delete_papers(store, papers(spark, "2").select("paper_id"))
    assert "paper:2" not in named(nodes["paper:2"].title) and store.read("lengths").count() == store.read("nodes").count()
    left = {r.node_id for r in store.read("nodes").collect()}
    # the method still extends another one; the dataset had no edge to the paper
    mine = {"paper:1", "author:Ann Lee", foo.node_id, bar.node_id, "new:Dataset:fooqa", "new:Dataset:barqa"}
    assert left == mine | {k for k, r in nodes.items() if r.source_paper_id == "1"}
    assert not any("paper:2" in k for k in graph(store)) and {r.paper_id for r in store.read("chunks").collect()} == {"1"}
    assert {r.paper_id for r in store.read("entity_papers").collect()} == {"1"} and states(store) == {"1": "completed"}


def test_a_rerun_asks_only_what_is_missing(spark, store, tmp_path):
    log = tmp_path / "calls"
    with pytest.raises(Exception, match="out of order"):
        ingest_batch(store, papers(spark, "1", "2"), model(log, fail="within"), dimension=8, pause=0)
    assert states(store) == {"1": "failed", "2": "failed"} and graph(store) == {}
    assert {r.paper_id for r in store.read("chunks").collect()} == {"1", "2"}  # the first part stays
    assert calls(log)["entities"] == 2 and store.read("units").where("kind = 'entities'").count() == 2
    ingest_batch(store, papers(spark, "1", "2"), model(log), dimension=8, pause=0)
    assert states(store) == {"1": "completed", "2": "completed"} and calls(log)["entities"] == 2
    assert store.read("units").isEmpty()
    before = calls(log)
    version = ingest_batch(store, papers(spark, "1", "2"), model(log), dimension=8, pause=0)
    assert calls(log) == before and version == store.version()
    assert {r for _, _, r in graph(store)} == {"AUTHORED_BY", "REPORTS_RESULT", "USES_METHOD"}


def test_a_failed_first_part_keeps_no_chunks(spark, store, tmp_path):
    def broken(batch):
        raise ValueError("no sections")

    with pytest.raises(ValueError, match="no sections"):
        ingest_batch(store, papers(spark, "3"), model(tmp_path / "calls"), dimension=8, pause=0, chunk=broken)
    assert states(store) == {"3": "failed"} and store.read("chunks").isEmpty() and calls(tmp_path / "calls")["entities"] == 0
    assert store.read("jobs").first().error_message == "no sections"
