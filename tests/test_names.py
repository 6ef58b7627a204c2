import random
from difflib import SequenceMatcher

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from citeloom.functions import names as n


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs_matches_dynamic_programme(a, b):
    assert n.lcs_length(a, b) == lcs(a, b)


def windows(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, k = len(short), len(long)
    spans = [long[:i] for i in range(1, m)] + [long[i:i + m] for i in range(k - m + 1)] + [long[i:] for i in range(k - m + 1, k)]
    best = max((n.indel_ratio(short, w) for w in spans), default=0.0)
    if m == k:
        best = max([best] + [n.indel_ratio(long, short[:i]) for i in range(1, m)] + [n.indel_ratio(long, short[i:]) for i in range(1, m)])
    return best


@given(st.text("abc ", min_size=1, max_size=8), st.text("abcd ", min_size=1, max_size=25))
@settings(max_examples=300, deadline=None)
def test_partial_ratio_matches_all_windows(a, b):
    assert abs(n.best_window_ratio(a, b) - windows(a, b)) < 1e-9
    for floor in (40.0, 70.0):
        assert (n.best_window_ratio(a, b, floor) >= floor) == (windows(a, b) >= floor)


def test_partial_ratio_edges():
    assert n.best_window_ratio("RoBERTa", "We call our approach RoBERTa.") == 100.0
    assert n.best_window_ratio("BERTBASE", "DistilBERT, a distilled version of BERT.") < 70
    assert n.best_window_ratio("", "") == 100.0 and n.best_window_ratio("", "x") == 0.0


def test_variants(spark):
    cases = [("BERT", "BERT-base"), ("GPT", "GPT2"), ("BERT", "BERTHA"), ("BERT", "ALBERT"), ("Wikipedia", "English Wikipedia"),
             ("BERT", "Bidirectional Encoder Representations from Transformers"), ("b", "b c"), ("bert", "BERT"), ("can", "can can-can")]
    df = spark.createDataFrame(cases, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", n.is_prefix_variant(a, b).alias("p"), n.is_acronym_variant(a, b).alias("c"), n.is_contained(a, b).alias("s"),
                     n.name_similarity(a, b).alias("x")).collect()
    got = {(r.a, r.b): (r.p, r.c, r.s) for r in rows}
    assert got[("BERT", "BERT-base")][0] and got[("GPT", "GPT2")][0]
    assert got[("BERT", "BERTHA")] == (False, False, False) and got[("BERT", "ALBERT")] == (False, False, False)
    assert got[("Wikipedia", "English Wikipedia")] == (False, False, True)
    assert got[("BERT", "Bidirectional Encoder Representations from Transformers")] == (False, True, False)
    assert got[("b", "b c")] == (False, False, False) and got[("bert", "BERT")] == (True, False, False)
    assert {(r.a, r.b): r.x for r in rows}[("BERT", "ALBERT")] == SequenceMatcher(None, "bert", "albert").ratio()


def test_acronym_skips_stopwords(spark):
    df = spark.createDataFrame([("GLUE", "General Language Understanding Evaluation"), ("SOA", "State of the Art"), ("SA", "State of the Art")], "a string, b string")
    assert [r[0] for r in df.select(n.is_acronym_variant(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_ratio_argument_order_is_kept(spark):
    random.seed(5)
    pairs = [("".join(random.choices("abcd ", k=9)), "".join(random.choices("abcd ", k=9))) for _ in range(40)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", n.normalised_ratio("a", "b").alias("r")).collect()
    assert all(r.r == SequenceMatcher(None, r.a, r.b).ratio() for r in rows)


def test_signatures_differ_by_no_more_than_the_edits(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab09-é\U0001F600") for _ in range(rng.randrange(1, 30))) for _ in range(80)] + ["aaaaaaaaaaaaaaaaaaaa", "p0p0"]
    pairs = [(a, b, len(a) + len(b) - 2 * lcs(a, b)) for a in texts[:40] for b in texts[40:]]
    rows = spark.createDataFrame(pairs, "a string, b string, edits int").select(
        "a", "b", "edits", n.signature_distance(n.letter_signature(F.col("a")), n.letter_signature(F.col("b"))).alias("bits"),
        n.ratio_above(F.col("a"), F.col("b"), 0.6).alias("score")).collect()
    assert all(r.bits <= r.edits for r in rows) and any(0 < r.bits for r in rows)
    for r in rows:
        ratio = SequenceMatcher(None, r.a, r.b).ratio()
        assert r.score == (ratio if ratio > 0.6 else 0.0)


@given(st.text("abc ", max_size=12), st.text("abcdé ", max_size=40), st.sampled_from((20.0, 40.0, 70.0, 90.0)))
@settings(max_examples=300, deadline=None)
def test_window_floor_matches_all_windows(a, b, floor):
    if a and b:
        assert (n.best_window_ratio(a, b, floor, floor) >= floor) == (windows(a, b) >= floor)


def test_windows_far_below_the_floor_are_not_all_compared(monkeypatch):
    calls, whole = [], n._whole_lcs
    monkeypatch.setattr(n, "_whole_lcs", lambda *args: calls.append(1) or whole(*args))
    rng = random.Random(2)
    short = "".join(rng.choice("abcdefghij ") for _ in range(600))
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz" * 3 + " ") for _ in range(6000))
    assert n.best_window_ratio(short, long, 40.0, 40.0) < 40.0
    assert 0 < len(calls) < 200  # of 5401 windows of full length
