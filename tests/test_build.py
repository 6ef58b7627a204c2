
from pyspark.sql import functions as F

from citeloom.operators.build import EDGE_FIELDS, build_graph, extract_batch
from citeloom.operators.extract import ACROSS_TASK, ENTITY_TASK
from citeloom.schema import NODES

PAPERS = "paper_id string, title string, authors array<string>, year int, venue string, abstract string, collection_id string, sections array<struct<ord:int,name:string,text:string>>"


def test_batch_from_papers_to_graph(spark):
    entity_task, across_task = ENTITY_TASK, ACROSS_TASK

    def model():
        """Reads the section's text: every capitalised token ending in Net is a method, in QA a dataset."""
        from json import dumps

        def complete(system, prompt):
            text = prompt.rsplit("\n\n", 1)[1]
            words = [w.strip(".,") for w in text.split()]
            methods = list(dict.fromkeys(w for w in words if w.endswith("Net") or w.endswith("Net-v2")))
            data = list(dict.fromkeys(w for w in words if w.endswith("QA")))
            if system == entity_task:
                return dumps({"methods": [{"name": m, "description": f"the {m} model", "confidence": 0.9} for m in methods],
                                   "datasets": [{"name": x, "confidence": 0.9} for x in data],
                                   "claims": [{"text": text.split(".")[0] + ".", "type": "RESULT", "confidence": 0.8}]})
            if system == across_task:
                return dumps({"relations": [{"type": "EXTENDS", "source": methods[0], "target": "OldNet", "confidence": 0.9}] if methods else []})
            return dumps({"relations": [{"type": "USES_METHOD", "target": m, "evidence_text": "uses " + m, "confidence": 0.9} for m in methods]
                               + [{"type": k, "target": x, "confidence": 0.8, "metric": "F1"} for x in data for k in ("EVALUATES_ON", "TRAINED_ON")]
                               + [{"type": "EVALUATES_ON", "target": m, "confidence": 0.8} for m in methods]})

        return complete

    papers = spark.createDataFrame([
        ("1", "First", [" Ann Lee"], 2020, None, None, "A", [(0, "abstract", "FooNet is good on FooQA. More."), (1, "results", "FooNet is good on FooQA. Again."), (2, "references", "BadNet is cited.")]),
        ("2", "Second", ["Ann Lee", "Bo Ray"], None, "V", "x", None, [(0, "method", "FooNet-v2 improves BarNet on OldQA.")]),
    ], PAPERS)
    columns = [f.name for f in NODES.fields]
    stored = spark.createDataFrame([tuple({"node_id": i, "label": lab, "name": n}.get(c) for c in columns) for i, lab, n in
                                    (("m0", "Method", "OldNet"), ("d0", "Dataset", "oldqa"))], NODES)
    edges = spark.createDataFrame([], "src string, dst string, rel_type string, confidence double, evidence_text string, metric string, value string, dataset string, margin string, occurrence_count long")
    got = extract_batch(papers, stored, [model], 16, pause=0)
    assert {(r.paper_id, r.entities_found) for r in got.totals.collect()} == {("1", 5), ("2", 4)}  # the repeated claim went
    out = build_graph(papers, got, stored, edges, dimension=16)
    nodes = {r.node_id: r for r in out["nodes"].collect()}
    assert {k for k, r in nodes.items() if r.label == "Method"} == {"m0", "new:Method:foonet", "new:Method:barnet"}
    assert nodes["new:Method:foonet"].name == "FooNet" and nodes["d0"].name == "oldqa"
    assert {k for k, r in nodes.items() if r.label == "Author"} == {"author:Ann Lee", "author:Bo Ray"}
    e = {(r.src, r.dst, r.rel_type): r for r in out["edges"].collect()}
    foo_edge = e[("paper:1", "new:Method:foonet", "USES_METHOD")]
    assert foo_edge.occurrence_count == 2 and foo_edge.evidence_text == "uses FooNet"
    assert ("paper:1", "new:Dataset:fooqa", "EVALUATES_ON") in e and ("paper:1", "new:Dataset:fooqa", "TRAINED_ON") not in e
    assert ("paper:1", "new:Method:foonet", "EVALUATES_ON") not in e  # wrong target label
    assert ("new:Method:foonet", "m0", "EXTENDS") in e and ("paper:2", "d0", "EVALUATES_ON") in e
    assert not any("BadNet" in k[1] for k in e)
    assert {r.alias for r in out["aliases"].collect()} == {"FooNet-v2"}
    assert {(r.node_id, r.paper_id) for r in out["entity_papers"].collect()} >= {("new:Method:foonet", "1"), ("new:Method:foonet", "2"), ("d0", "2")}
    assert out["entity_vectors"].filter(F.size("vector") == 16).count() == 2 + 3 + 2 - 1 + len({k for k in nodes if k.startswith("claim:")})

    again = build_graph(papers, got, out["nodes"], out["edges"].select("src", "dst", "rel_type", *EDGE_FIELDS, "occurrence_count"), dimension=16)
    assert {r.node_id for r in again["nodes"].collect()} == set(nodes)
    assert {(r.src, r.dst, r.rel_type): r.occurrence_count for r in again["edges"].collect()} == {k: 2 * r.occurrence_count for k, r in e.items()}


def test_whole_graph_looks_up_ends_once_and_drops_edges_without_nodes(spark, monkeypatch):
    from citeloom.operators import browse

    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", "X"), ("a", "z", "X"), ("y", "b", "X"), (None, "b", "X"), ("c", "c", "Y")], "src string, dst string, rel_type string")
    stored, looked_up = [], browse.written
    monkeypatch.setattr(browse, "written", lambda df, name: stored.append(name) or looked_up(df, name))
    assert sorted(tuple(r) for r in browse.whole_graph(nodes, edges)[1].select("src", "dst", "rel_type").collect()) == [("a", "b", "X"), ("c", "c", "Y")]
    assert stored == ["unknown-ends"]


def test_stored_graph_builds_only_what_is_read(spark, monkeypatch):
    from citeloom.plans import domain

    built = []
    monkeypatch.setattr(domain, "written", lambda df, name: built.append(name) or df)
    stored = domain.Stored(spark, "/root/testdata/sf0.001")
    assert stored.nodes is stored.nodes and built == ["nodes"]


def test_writes_are_grouped_without_combining_them_in_the_input_tasks(spark):
    from citeloom.plans import domain

    rows = domain.raw_relations(spark, "/root/testdata/sf0.001")
    planned = rows.groupBy("src", "dst", "rel_type").count()._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange") == 1
