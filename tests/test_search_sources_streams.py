import collections
import json
import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citeloom.operators.search import alike, search, searchable
from citeloom.sources import checkpoints, feeds, files
from citeloom.streaming import jobs


def bm25(texts, query, limit, allowed=None):
    out = []
    for label in {t[1] for t in texts}:
        docs = {i: re.findall(r"\w+", x.lower()) for i, lab, x in texts if lab == label}
        mean = sum(map(len, docs.values())) / len(docs)
        df = collections.Counter(w for ws in docs.values() for w in set(ws))
        scored = []
        for i, ws in docs.items():
            tf = collections.Counter(ws)
            hit = [w for w in set(re.findall(r"\w+", query.lower())) if tf[w]]
            if hit and (allowed is None or i in allowed):
                s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in hit)
                scored.append((-round(s, 6), i))
        out += sorted(scored)[:limit]
    return [i for _, i in sorted(out)[:limit]]


@pytest.mark.parametrize("limit", [3, 10])
def test_search_equals_scoring_every_node(spark, limit):
    rng = random.Random(9)
    words = ["the"] * 12 + ["of"] * 6 + ["net", "deep", "graph", "bert", "data", "x1", "x2", "x3", "x4"]
    texts = [(f"n{i:03}", rng.choice(["Paper", "Method"]), " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(200)]
    queries = [(0, "the of"), (1, "the deep net"), (2, "of bert x1"), (3, "unseen"), (4, "x2 x3 x4 the data graph"), (5, "bert")]
    t = spark.createDataFrame(texts, "node_id string, label string, text string")
    q = spark.createDataFrame(queries, "query_id int, text string")
    allowed = {f"n{i:03}" for i in range(0, 200, 3)}
    within = spark.createDataFrame([(a,) for a in sorted(allowed)], "node_id string")
    for keep, frame in ((None, None), (allowed, within)):
        got = collections.defaultdict(list)
        for r in search(t, q, limit, within=frame).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.node_id)
        for i, text in queries:
            assert got[i] == bm25(texts, text, limit, keep), (i, keep is None)


def test_search_refuses_unknown_labels(spark):
    t = spark.createDataFrame([("n", "Paper", "x")], "node_id string, label string, text string")
    with pytest.raises(ValueError):
        search(t, spark.createDataFrame([(1, "x")], "query_id int, text string"), labels=["Metric"])


def test_search_reads_abstracts_and_descriptions(spark):
    nodes = spark.createDataFrame([("p", "Paper", None, "T", None, "about zebras", None), ("m", "Method", "M", None, None, None, "counts zebras")],
                                  "node_id string, label string, name string, title string, text string, abstract string, description string")
    found = search(searchable(nodes), spark.createDataFrame([(1, "zebras")], "query_id int, text string"))
    assert {r.node_id for r in found.collect()} == {"p", "m"}


def test_upload_statuses(spark):
    pdf = lambda b: bytearray(b"%PDF-" + b)
    rows = [(1, "a.pdf", pdf(b"1")), (1, "b.pdf", pdf(b"1")), (1, "c.txt", bytearray(b"no")), (1, "d.pdf", pdf(b"old"))]
    rows += [(2, f"{i:02}.pdf", pdf(b"two%d" % i)) for i in range(51)]
    df = spark.createDataFrame(rows, "batch_id int, filename string, content binary")
    stored = df.filter("filename = 'd.pdf'").select(F.sha2("content", 256).alias("content_hash"), F.lit("P").alias("paper_id"))
    got = {r.filename: (r.status, r.error, r.paper_id) for r in files.upload(df, stored, F.col("filename")).filter("batch_id = 1").collect()}
    assert got["a.pdf"][0] == "queued" and got["b.pdf"][0] == "duplicate" and got["d.pdf"] == ("duplicate", None, "P")
    assert got["c.txt"][:2] == ("rejected", "c.txt: not a valid PDF (missing %PDF- header)")
    assert {r.status for r in files.upload(df, stored, F.col("filename")).filter("batch_id = 2").collect()} == {"queued"}


def test_size_limit(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-" + b"x" * 1_100_000),)], "content binary")
    assert df.select(files.rejection(F.col("content"), 1)).first()[0] == "1.0MB exceeds the 1MB limit"


def test_file_scan_parse_and_papers(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-\nPaper T\nabstract\nShort.\nmethod\nLong\x00.")
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    (tmp_path / "note.txt").write_bytes(b"%PDF-\nskipped")

    def plain(content):
        head, _, text = content.decode().partition("\n")
        if head != "%PDF-":
            raise ValueError("bad header")
        return {"full_text": text, "pages": [text], "layout": [{"size": 20.0, "text": "Paper T"}, {"size": 11.0, "text": "Ann Lee"}, {"size": 11.0, "text": "Abstract"}]}

    parsed = files.parse(files.scan(spark, str(tmp_path)), plain)
    assert {r.path.rsplit("/", 1)[1]: r.error for r in parsed.collect()} == {"ok.pdf": None, "bad.pdf": "could not parse: bad header"}
    paper = files.papers_from(parsed).first()
    assert paper.title == "Paper T" and paper.authors == ["Ann Lee"]
    assert [(s["name"], s["text"]) for s in paper.sections] == [("preamble", "Paper T"), ("abstract", "Short."), ("method", "Long.")]


def test_html_papers(spark):
    html = "<html><title>A &amp; B</title><script>var a='<p>';</script><body><h1>Top</h1><!-- x --><p>One<br>two</p></body></html>"
    row = files.html_papers(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row.text == "A & B\nTop\nOne\ntwo" and row.pages == [row.text]


def test_atom_metadata(spark):
    ok = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://a/abs/1</id><title>Deep\n  Nets</title><summary> S\n s </summary>'
          "<published>2017-06-12T00:00:00Z</published><author><name>Ann Lee</name></author><author><name> Bo Ray </name></author></entry></feed>")
    bad = ok.replace("a/abs/1", "a/api/errors#1")
    rows = spark.createDataFrame([(1, ok), (2, bad), (3, "<feed></feed>")], "i int, x string").orderBy("i").select(feeds.atom_metadata(F.col("x")).alias("m")).collect()
    assert rows[0].m.asDict() == {"title": "Deep Nets", "authors": ["Ann Lee", "Bo Ray"], "abstract": "S s", "year": 2017}
    assert rows[1].m is None and rows[2].m is None


def test_evaluation_set(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"_meta": {}, "papers": [{"id": "p", "title": "T"}], "questions": [{"id": "q1", "category": "c", "question": "?", "gold_answer": "g", "source_papers": ["p"]}]}, indent=1))
    papers, questions = feeds.evaluation_set(spark, str(path))
    assert papers.first().title == "T" and questions.first().source_papers == ["p"]


def test_checkpoints_resume_and_ignore_corrupt_units(spark, tmp_path):
    folder = str(tmp_path / "marks")
    units = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "paper_id string, section string")
    assert checkpoints.unfinished(units, checkpoints.load(spark, folder, "entities")).count() == 3
    done = spark.createDataFrame([("p", "a", "entities", "{}"), ("p", "b", "entities", "{oops"), ("q", "a", "relations", "[]")], "paper_id string, section string, kind string, data string")
    checkpoints.save(done, folder)
    assert {(r.paper_id, r.section) for r in checkpoints.unfinished(units, checkpoints.load(spark, folder, "entities")).collect()} == {("p", "b"), ("q", "a")}
    assert checkpoints.remaining_after_clear(done, units.filter("paper_id = 'p'")).count() == 1


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "paper_id string, text string")
    rows("1", "2", "2").write.mode("append").parquet(source)

    def go():
        arrivals = jobs.stream_tables(spark, source, rows("1").schema)
        jobs.ingest(arrivals, lambda b: b.withColumn("text", F.upper("text")), target, marks).awaitTermination()
        return sorted((r.paper_id, r.text) for r in spark.read.parquet(target).collect())

    assert go() == [("1", "T1"), ("2", "T2")]
    rows("2", "3").write.mode("append").parquet(source)
    assert go() == [("1", "T1"), ("2", "T2"), ("3", "T3")] == go()
    states = spark.read.parquet(jobs.states_folder(target))
    assert sorted((r.job_id, r.status) for r in states.collect()) == [(i, s) for i in "123" for s in ("completed", "queued")]


def test_papers_without_rows_fail(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "paper_id string, text string")
    rows.write.parquet(source)
    jobs.ingest(jobs.stream_tables(spark, source, rows.schema), lambda b: b.filter("paper_id = '1'"), target, marks).awaitTermination()
    last = jobs.latest_status(spark.read.parquet(jobs.states_folder(target)).select("job_id", "status", "ts"))
    assert {r.job_id: r.status for r in last.collect()} == {"1": "completed", "2": "failed"}


def test_recent_requests_equal_direct_count(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice("ab"), start + timedelta(seconds=rng.randint(0, 400))) for i in range(200)]
    df = spark.createDataFrame(rows, "request_id int, client string, ts timestamp")
    got = {r.request_id: r.recent for r in jobs.recent_requests(df, 60).collect()}
    assert got == {i: sum(c2 == c and 0 <= (t - t2).total_seconds() <= 60 for _, c2, t2 in rows) for i, c, t in rows}
    assert jobs.waits(df, 10).count() == sum(v > 10 for v in got.values())


def test_over_limit_as_table_and_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=i)) for i in range(5)] + [("b", start + timedelta(seconds=61))]
    df = spark.createDataFrame(rows, "client string, ts timestamp")
    table = {(r.client, r.requests) for r in jobs.over_limit(df, 3).collect()}
    df.write.parquet(str(tmp_path / "r"))
    live = jobs.over_limit(jobs.stream_tables(spark, str(tmp_path / "r"), df.schema), 3)
    run = live.writeStream.outputMode("complete").format("memory").queryName("limits").trigger(availableNow=True).start()
    run.awaitTermination()
    assert table == {("a", 5)} == {(r.client, r.requests) for r in spark.table("limits").collect()}


def test_job_states(spark):
    t = datetime(2024, 1, 1)
    h = spark.createDataFrame([("j", "queued", t), ("j", "chunking", t), ("j", "parsing", t), ("k", "failed", t)], "job_id string, status string, ts timestamp")
    assert {r.job_id: r.status for r in jobs.latest_status(h).collect()} == {"j": "chunking", "k": "failed"}
    moves = [("queued", "parsing", True), ("parsing", "queued", False), ("writing_graph", "failed", True), ("completed", "failed", False), ("queued", "completed", True)]
    df = spark.createDataFrame(moves, "a string, b string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(jobs.valid_transition(F.col("a"), F.col("b")), "ok").collect())
    o = spark.createDataFrame([(True, True), (True, False), (False, False)], "p boolean, e boolean").select(jobs.outcome(F.col("p"), F.col("e")).alias("o")).collect()
    assert [tuple(r.o) for r in o] == [("completed", "completed", True), ("completed", "failed", True), ("failed", "failed", False)]


def test_queries_of_the_same_words_share_one_ranking(spark):
    rng = random.Random(12)
    words = ["the"] * 9 + ["of"] * 4 + ["net", "deep", "graph"]
    texts = [(f"n{i:04}", rng.choice(["Paper", "Method"]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(400)]
    asked = [(q, ("the net", "Net the unseen", "of deep", "graph")[q % 4]) for q in range(40)]
    frame, queries = spark.createDataFrame(texts, "node_id string, label string, text string"), spark.createDataFrame(asked, "query_id int, text string")
    got = collections.defaultdict(list)
    for r in search(frame, queries, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.node_id)
    for q, text in asked:
        assert got[q] == bm25(texts, text, 10), q
    terms = queries.selectExpr("query_id", "explode(split(lower(text), ' ')) AS term")
    held = frame.selectExpr("label", "explode(split(text, ' ')) AS term").filter("term <> ''").distinct()
    assert {r.leader for r in alike(terms, held).collect()} == {0, 2, 3}
