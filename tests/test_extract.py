import json
import random

import numpy as np
from pyspark.sql import functions as F

from citeloom.functions import replies
from citeloom.functions.generation import Exhausted, Refused, Ring
from citeloom.operators import extract as ex
from citeloom.operators import link


def test_ring_retries_then_moves_forward():
    calls = []

    def flaky():
        def complete(system, user):
            calls.append("a")
            raise TimeoutError

        return complete

    def spent():
        def complete(system, user):
            calls.append("b")
            raise Exhausted

        return complete

    ring = Ring([flaky, spent, lambda: lambda s, u: calls.append("c") or "ok"], attempts=3, pause=0)
    assert ring.ask("s", "u") == "ok" and ring.ask("s", "u") == "ok"
    assert calls == ["a", "a", "a", "b", "c", "c"]


def test_ring_stops_on_refusal_and_when_empty():
    def refusing():
        def complete(system, user):
            raise Refused("key")

        return complete

    for ring, kind in ((Ring([refusing, lambda: lambda s, u: "x"]), Refused), (Ring([]), Exhausted)):
        try:
            ring.ask("s", "u")
            raise AssertionError
        except kind:
            pass


def test_json_recovery(spark):
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} bye', "no json", '{"a": ', "```\n{\"a\": 1}```"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(F.get_json_object(replies.recover_json(F.col("raw")), "$.a")).collect()]
    assert got == ["1", "1", "1", None, None, "1"]


def test_confidence_clamp(spark):
    df = spark.createDataFrame([("0.7",), ("3",), ("-1",), ("high",), (None,), ("nan",)], "v string")
    assert [r[0] for r in df.select(replies.confidence(F.col("v"))).collect()] == [0.7, 1.0, 0.0, 0.0, 0.0, 1.0]


SECTION = "We propose DeepNet and evaluate on SQuAD. DeepNet improves accuracy a lot."


def entities(spark, reply, text=SECTION, name="method"):
    sections = spark.createDataFrame([("p", 0, name, text)], "paper_id string, ord int, name string, text string")
    answers = reply if isinstance(reply, list) else [reply]

    def provider():
        state = {"n": 0}

        def complete(system, user):
            state["n"] += 1
            return answers[min(state["n"], len(answers)) - 1]

        return complete

    return ex.extract_entities(sections, [provider], pause=0).orderBy("kind", "pos").collect()


def test_entities_are_thresholded_typed_and_grounded(spark):
    reply = json.dumps({
        "methods": [{"name": " DeepNet ", "confidence": 0.5}, {"name": "JXLNet", "confidence": 1}, {"name": "", "confidence": 1}, {"name": "We", "confidence": 0.49}, 7],
        "datasets": [{"name": "SQuAD", "domain": "qa", "confidence": "0.9"}],
        "metrics": [{"name": "F1", "value": 93, "method": "", "confidence": 0.9}],
        "claims": [{"text": "DeepNet improves accuracy", "type": "result", "confidence": 0.8}, {"text": "DeepNet improves", "type": "Guess", "confidence": 0.8},
                   {"text": "QZQZQZ 0000 KKKK", "type": "RESULT", "confidence": 0.9}]})
    rows = entities(spark, reply)
    assert [(r.kind, r.name) for r in rows] == [("claim", "DeepNet improves accuracy"), ("dataset", "SQuAD"), ("method", "DeepNet"), ("metric", "F1")]
    assert rows[3].value == "93" and rows[3].method is None and rows[0].claim_type == "RESULT" and rows[1].category == "qa"


def test_unreadable_reply_is_asked_once_more(spark):
    good = json.dumps({"methods": [{"name": "DeepNet", "confidence": 1}]})
    assert len(entities(spark, ["oops", good])) == 1
    assert entities(spark, ["oops", "oops", good]) == []
    assert entities(spark, good, text="  \n") == []


def test_relations_parse_defaults_and_extras(spark):
    sections = spark.createDataFrame([("p", 0, "method", SECTION)], "paper_id string, ord int, name string, text string")
    names = spark.createDataFrame([("p", 0, ["DeepNet"])], "paper_id string, ord int, names array<string>")
    reply = json.dumps({"relations": [
        {"type": "evaluates_on", "target": "SQuAD", "evidence_text": "e", "confidence": 0.9, "metric": "F1", "value": 93.5, "margin": None},
        {"type": "EXTENDS", "source": "DeepNet", "target": "BERT", "confidence": 0.9}, {"type": "TRAINED_ON", "confidence": 1}, "x",
        {"type": "TRAINED_ON", "target": "Wiki", "confidence": 0.49}]})
    seen = []

    def provider():
        return lambda s, u: seen.append(u) or reply

    row, = ex.extract_relations(sections, names, [provider], pause=0).collect()
    assert (row.relation_type, row.source, row.target, row.properties) == ("EVALUATES_ON", "paper", "SQuAD", {"metric": "F1", "value": "93.5"})
    offered = spark.createDataFrame([("p", [("BERT", "Method")], "- BERT (Method)")], "paper_id string, offered array<struct<name:string,entity_type:string>>, listed string")
    across = ex.extract_relations(sections, names, [provider], across=True, candidates=offered, pause=0)
    assert [(r.source, r.target) for r in ex.known_targets(across, offered).collect()] == [("DeepNet", "BERT")]
    other = offered.withColumn("paper_id", F.lit("q"))
    assert ex.extract_relations(sections, names, [provider], across=True, candidates=other, pause=0).count() == 0


def test_all_entities_are_offered_in_pages(spark):
    existing = spark.createDataFrame([(f"n{i:02}", f"Net {i:02}", "Method") for i in range(10)] + [("n99", "NET 04", "Dataset")], "node_id string, name string, entity_type string")
    own = spark.createDataFrame([("p", "net  03"), ("p", "Net 05"), ("q", None)], "paper_id string, name string")
    pages = {(r.paper_id, r.page): [c.name for c in r.offered] for r in ex.foreign_candidates(existing, own, per_prompt=3).collect()}
    nets = [f"Net {i:02}" for i in range(10)]
    assert pages == {("p", 0): nets[:3], ("p", 1): nets[4:5], ("p", 2): nets[6:9], ("p", 3): [nets[9], "NET 04"],
                     ("q", 0): nets[:3], ("q", 1): nets[3:6], ("q", 2): nets[6:9], ("q", 3): [nets[9], "NET 04"]}
    assert ex.foreign_candidates(existing.limit(0), own).count() == 0

    def provider():
        def complete(system, prompt):
            shown = [line[2:].rpartition(" (")[0] for line in prompt.split("\n") if line.startswith("- ")]
            return json.dumps({"relations": [{"type": "EXTENDS", "source": "s", "target": x, "confidence": 1} for x in [*shown, "Net 05"]]})
        return complete

    sections = spark.createDataFrame([("p", 0, "method", "Text."), ("q", 1, "method", "Text.")], "paper_id string, ord int, name string, text string")
    names = spark.createDataFrame([], "paper_id string, ord int, names array<string>")
    offered = ex.foreign_candidates(existing, own, per_prompt=3)
    rows = ex.extract_relations(sections, names, [provider], across=True, candidates=offered, pause=0)
    assert [r.pos for r in rows.filter("paper_id = 'p'").orderBy("pos").collect()] == list(range(13))
    known = [(r.paper_id, r.target) for r in ex.known_targets(rows, offered).orderBy("paper_id", "pos").collect()]
    assert [t for p, t in known if p == "p"] == nets[:3] + nets[4:5] + nets[6:] + ["NET 04"]
    assert len([t for p, t in known if p == "q"]) == 15


def greedy(lengths, sim, floor):
    """Index-major double loop over all pairs."""
    gone = set()
    for i in range(len(lengths)):
        if i in gone:
            continue
        for j in range(i + 1, len(lengths)):
            if j in gone or sim[i][j] <= floor:
                continue
            gone.add(i if lengths[i] < lengths[j] else j)
    return {i for i in range(len(lengths)) if i not in gone}


def test_claim_dedup_equals_double_loop(spark):
    rng = np.random.default_rng(4)
    random.seed(4)
    rows, want = [], {}
    for paper in range(30):
        n = int(rng.integers(1, 14))
        base = rng.normal(size=(4, 5))
        vec = np.array([base[rng.integers(4)] + rng.normal(scale=0.25, size=5) for _ in range(n)])
        texts = [("w" * random.randint(1, 5)) + str(i) for i in range(n)]
        if n > 3:
            texts[3], vec[3] = texts[0], vec[0]
        unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
        want[paper] = greedy([len(x) for x in texts], np.round(unit @ unit.T, 9), 0.9)
        rows += [(paper, i, texts[i], [float(v) for v in vec[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "paper_id long, seq int, text string, vector array<double>").repartition(3)
    got = {p: set() for p in want}
    for r in ex.dedupe_claims(df, 0.9).collect():
        got[r.paper_id].add(r.seq)
    assert got == want


def test_targets_are_looked_up_in_the_lists(spark):
    offered = spark.createDataFrame(
        [("p", 0, [("A", "Method"), ("B", "Dataset")]), ("p", 1, [("C", "Method"), (None, "Method")]), ("q", 0, [("A", "Method")])],
        "paper_id string, page int, offered array<struct<name:string,entity_type:string>>")
    relations = spark.createDataFrame(
        [("p", "A", 1), ("p", "A", 2), ("p", "C", 3), ("p", "a", 4), ("p", None, 5), ("q", "B", 6), ("q", "A", 7), ("r", "A", 8)],
        "paper_id string, target string, pos int")
    kept = ex.known_targets(relations, offered)
    assert "Generate" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in kept.collect()) == [1, 2, 3, 7]


def test_claims_in_blocks_equal_double_loop_and_are_dealt_once(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 3))
    vec = base[rng.integers(12, size=150)] + rng.normal(scale=0.2, size=(150, 3))
    unit, lengths = vec / np.linalg.norm(vec, axis=1, keepdims=True), [int(x) for x in rng.integers(1, 9, size=150)]
    want = greedy(lengths, np.round(unit @ unit.T, 9), 0.95)
    for cells in (1, 700, 4_000_000):
        assert {i for i, kept in enumerate(ex._surviving(lengths, unit, 0.95, cells)) if kept} == want
    claims = spark.range(100).select((F.col("id") % 7).alias("paper_id"), F.col("id").alias("seq"), F.lit("x").alias("text"), F.array(F.lit(1.0)).alias("vector"))
    assert ex.dedupe_claims(claims)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_title_and_trivial_claims(spark):
    rows = [("p", "claim", "A Study of Deep Nets"), ("p", "claim", "Results table"), ("p", "claim", "Nets win often"), ("p", "claim", "It improves speed"), ("p", "method", "Nets")]
    df = spark.createDataFrame(rows, "paper_id string, kind string, name string")
    papers = spark.createDataFrame([("p", "A study of deep nets")], "paper_id string, title string")
    assert {r.name for r in ex.drop_title_and_trivial_claims(df, papers).collect()} == {"It improves speed", "Nets"}


def test_faithfulness_fails_open(spark):
    df = spark.createDataFrame([(1, "ctx", "low"), (2, "ctx", "edge"), (3, "ctx", "boom"), (4, "ctx", "odd"), (5, "", "low")], "i int, text string, answer string")

    def provider():
        def complete(system, user):
            word = user.rsplit("\n", 1)[1]
            if word == "boom":
                raise Refused("no")
            return {"low": '{"score": 0.59}', "edge": '{"score": 0.6}', "odd": "hm"}[word]

        return complete

    assert {r.i for r in ex.faithfulness_warning(df, [provider], pause=0).filter("warning is not null").collect()} == {1}


def test_link_rules(spark):
    rel = "paper_id string, relation_type string, source string, target string, evidence_text string, confidence double"
    rows = [("p", "EVALUATES_ON", "paper", "squad", "", 0.9), ("p", "TRAINED_ON", "paper", "SQuAD", "", 0.9), ("p", "TRAINED_ON", "paper", "Wiki", "", 0.9),
            ("p", "EVALUATES_ON", "paper", "BERT", "", 0.9), ("p", "CITES", "paper", "BERT", "", 0.9), ("p", "EXTENDS", "Mine", "bert ", "", 0.9),
            ("p", "EXTENDS", "unknown", "bert", "", 0.9), ("p", "INTRODUCES", "paper", "Mine", "we call it Mine", 0.9), ("p", "INTRODUCES", "paper", "BERT", "0000", 0.9)]
    stored = link.name_index(spark.createDataFrame([("BERT", "m1", "Method", 1), ("SQuAD", "d0", "Dataset", 1), ("squad", "d1", "Dataset", 2), ("wiki", "d2", "Dataset", 3)],
                                                   "name string, node_id string, label string, seq int"), [])
    own = link.name_index(spark.createDataFrame([("p", "mine", "m9", "Method", 1)], "paper_id string, name string, node_id string, label string, seq int"), ["paper_id"])
    out = link.linked_relations(spark.createDataFrame(rows, rel), stored, own, F.concat(F.lit("o:"), "paper_id"))
    assert sorted((r.relation_type, r.src, r.dst) for r in out.collect()) == [
        ("EVALUATES_ON", "o:p", "d1"), ("EXTENDS", "m9", "m1"), ("INTRODUCES", "o:p", "m9"), ("TRAINED_ON", "o:p", "d2")]
