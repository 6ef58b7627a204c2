import itertools
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm.mixing import (
    MISSING,
    PRESENT,
    PULL,
    SIZES,
    calibrate,
    fit_rates,
    keep_mixed,
    label_domains,
    labelled_texts,
    memberships,
    mix_documents,
    weigh_words,
)

LABELS = "doc_id long, quality int, toxic int, text string, tokens string"
TARGETS = {"good": 0.7, "low": 0.3, "toxic": 0.0}


def tables(spark, docs, extra=()):
    draw = random.Random(9)
    own = {"good": ["plain", "prose", "tells"], "low": ["###", "|", "click"], "toxic": ["vile", "slur", "hate"]}
    rows, labels, truth = [], [], {}
    for i in range(240):
        kind = ("good", "good", "low", "toxic")[i % 4]
        words = [draw.choice(own[kind]) if draw.random() < 0.3 else f"w{draw.randrange(30)}" for _ in range(draw.randrange(20, 60))]
        rows.append((i, " ".join(words)))
        truth[i] = kind
        if i % 3 == 0:
            labels.append((i, int(kind != "low"), int(kind == "toxic"), "t", "k"))
    labels += [(None, 1, 0, "t", "k"), (5000, 0, 0, "t", "k"), (1, None, None, "t", "k"), (3, 1, 0, "t", "k")]
    return docs([*rows, *extra]), spark.createDataFrame(labels, LABELS), truth


def test_totals_come_near_the_targets(spark, docs):
    d, labels, truth = tables(spark, docs)
    got = mix_documents(d, labels, TARGETS).cache()
    total = got.agg(F.sum("tokens")).first()[0]
    for name, share in TARGETS.items():
        held = got.agg(F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{name}"))).first()[0]
        assert abs(held - share * total) < 0.03 * total
        assert abs(got.first()[f"miss_{name}"] - (held / total - share)) < 1e-4
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(max(TARGETS, key=lambda k: rows[i][f"p_{k}"]) == kind for i, kind in truth.items() if i % 3)
    assert all(r["rate"] >= 0 and abs(sum(r[f"p_{k}"] for k in TARGETS) - 1) < 1e-6 for r in rows.values())


def least(weight, p, goal, pull):
    """Rates of least squared misses plus pull, by many plain projected gradient steps."""
    weight, p, goal = np.array(weight, float), np.array(p, float), np.array(goal, float)
    metric, rate = np.linalg.pinv((p.T * weight) @ p), np.ones(len(weight))
    for _ in range(20_000):
        slope = p @ (metric @ ((weight * rate) @ p - goal)) + pull * (rate - 1)
        rate = np.maximum(0, rate - slope / (1 + pull))
    return rate


@pytest.mark.parametrize("pull", [PULL, 0.3])
def test_rates_equal_plain_projected_gradient(spark, pull):
    draw = random.Random(3)
    rows = [(i, i, draw.randrange(0, 90), 1 + i % 2, *(lambda p: (p, 1 - p))(draw.choice([0.1, 0.25, draw.random()]))) for i in range(50)]
    members = spark.createDataFrame(rows, "doc_id long, _text_hash long, tokens int, copies long, p_0 double, p_1 double")
    fitted = fit_rates(members, ("a", "b"), {"a": 0.9, "b": 0.1}, pull=pull).collect()
    weight = [t * c for _, _, t, c, _, _ in rows]
    want = least(weight, [r[4:] for r in rows], [0.9 * sum(weight), 0.1 * sum(weight)], pull)
    got = {r["doc_id"]: r["rate"] for r in fitted}
    held = [sum(w * got[r[0]] * r[4 + k] for w, r in zip(weight, rows, strict=True)) / sum(weight) for k in (0, 1)]
    best = [sum(w * x * r[4 + k] for w, r, x in zip(weight, rows, want, strict=True)) / sum(weight) for k in (0, 1)]
    assert len(fitted) == 50 and all(abs(a - b) < 2e-3 for a, b in zip(held, best, strict=True))
    assert all(abs(got[i] - x) < 0.05 for i, x in enumerate(want))
    assert all(abs(fitted[0][f"miss_{k}"] - (held[k] - g)) < 1e-5 for k, g in enumerate((0.9, 0.1)))


def test_misses_that_stay_are_told_and_rates_stay_near_one(spark):
    kinds = [(0.8, (0.76, 0.13, 0.11)), (0.1, (0.3, 0.68, 0.02)), (0.1, (0.1, 0.1, 0.8))]
    rows = [(len(kinds) * i + n, 0, 50, 1, *p) for n, (share, p) in enumerate(kinds) for i in range(round(share * 400))]
    members = spark.createDataFrame(rows, "doc_id long, _text_hash long, tokens int, copies long, p_0 double, p_1 double, p_2 double")
    with pytest.warns(UserWarning, match="targets not met"):
        fitted = fit_rates(members, ("good", "low", "toxic"), {"good": 0.9, "low": 0.1, "toxic": 0.0}).collect()
    want = least([320, 40, 40], [p for _, p in kinds], [360, 40, 0], PULL)
    got = {r["p_0"]: r["rate"] for r in fitted}
    assert all(abs(got[p[0]] - x) < 0.02 for (_, p), x in zip(kinds, want, strict=True)) and got[0.76] > 0.5 and got[0.1] < 0.1


def test_weights_and_posteriors_equal_plain_counting(spark, docs):
    d, labels, _ = tables(spark, docs)
    domains = tuple(TARGETS)
    labelled = label_domains(labels)
    texts = labelled_texts(d, labelled, domains).collect()
    train = [r for r in texts if not r["held"]]
    held = [r for r in texts if r["held"]]
    assert train and held
    seen, read = {}, [len({r["family"] for r in train if r["domain"] == k}) for k in domains]
    for r in train:
        for w in r["features"]:
            seen.setdefault(w, set()).add((domains.index(r["domain"]), r["family"]))
    kept = {}
    for w, by in seen.items():
        c = [len({f for k, f in by if k == n}) for n in range(3)]
        chance = [(x + 0.5) / (t + 1) for x, t in zip(c, read, strict=True)]
        top = sorted(map(math.log, chance))
        gain = 2 * sum(h * math.log(h * sum(read) / (of * t)) for x, t in zip(c, read, strict=True) for h, of in ((x, sum(c)), (t - x, sum(read) - sum(c))) if h)
        if sum(c) >= 3 and top[2] - top[1] >= 1 and gain >= 12:
            kept[w] = (gain, [math.log(x) - math.log(1 - x) for x in chance], [math.log(1 - x) for x in chance])
    words = weigh_words(spark.createDataFrame(texts), domains)
    got = {r["word"]: r for r in words.collect()}
    assert set(got) == set(kept) and len(kept) >= 9
    assert all(abs(got[w][f"o_{k}"] - o[k]) < 1e-9 and abs(got[w][f"a_{k}"] - a[k]) < 1e-9 for w, (_, o, a) in kept.items() for k in range(3))
    prior = [-1.0, -1.5, -2.0]
    order = sorted(kept, key=lambda w: got[w]["rank"])
    assert all(kept[a][0] >= kept[b][0] - 1e-9 for a, b in itertools.pairwise(order))

    def score(features, size, present, missing):
        use = set(order[:size])
        return [prior[k] + present * sum(kept[w][1][k] for w in features if w in use) + missing * sum(kept[w][2][k] for w in use) for k in range(3)]

    def loss(size, present, missing):
        rows = [(score(r["features"], size, present, missing), domains.index(r["domain"])) for r in held]
        return sum(math.log(sum(math.exp(x) for x in z)) - z[t] for z, t in rows) / len(rows)

    size, present, missing, found = calibrate(spark.createDataFrame(texts), words, prior, domains)
    best = min(loss(m, p, q) for m in SIZES for p in PRESENT for q in MISSING)
    assert abs(found - best) < 1e-9 and abs(loss(size, present, missing) - best) < 1e-9
    rows = [("", *prior), (" ", *[missing * sum(kept[w][2][k] for w in order[:size]) for k in range(3)]), *[(w, *[present * x for x in kept[w][1]]) for w in order[:size]]]
    members = {r["doc_id"]: r for r in memberships(docs([(1, "vile slur w1"), (2, "plain plain w2"), (3, None), (3, None), (4, "###")]), spark.createDataFrame(rows, "word string, w_0 double, w_1 double, w_2 double"), domains).collect()}
    for i, features in ((1, ["vile", "slur", "w1"]), (2, ["plain", "w2"]), (4, ["###"])):
        z = score(features, size, present, missing)
        assert all(abs(members[i][f"p_{k}"] - math.exp(z[k]) / sum(map(math.exp, z))) < 1.6e-3 for k in range(3))
    assert members[3]["copies"] == 2 and abs(members[3]["p_0"] - math.exp(-1) / sum(map(math.exp, prior))) < 1.6e-3


def test_held_out_labels_of_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("test tables are not there")
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    domains, labelled = tuple(TARGETS), label_domains(labels)
    counts = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    texts = labelled_texts(documents, labelled, domains)
    words = weigh_words(texts, domains)
    prior = [math.log((counts[k] + 1) / (sum(counts.values()) + 3)) for k in domains]
    *_, loss = calibrate(texts, words, prior, domains)
    bare = -sum(counts[k] * prior[n] for n, k in enumerate(domains)) / sum(counts.values())
    assert loss < 0.65 * bare
    got = mix_documents(documents, labels, {"good": 0.85, "low": 0.15, "toxic": 0.0}).join(labelled, "doc_id")
    held = got.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).collect()
    right = {k: [max(domains, key=lambda x: r[f"p_{x}"]) == k for r in held if r["domain"] == k] for k in domains}
    assert sum(right["good"]) >= 0.97 * len(right["good"]) and sum(right["low"]) >= 0.6 * len(right["low"]) and sum(right["toxic"]) >= 0.4 * len(right["toxic"])
    assert got.first()["miss_toxic"] <= 0.065


def test_toxic_documents_go_and_others_stay(spark, docs):
    extra = [(900, None), (901, ""), (902, "plain " * 20_000), (None, "plain prose tells"), (903, "plain prose"), (903, "plain prose"), (904, "vile slur hate vile")]
    d, labels, truth = tables(spark, docs, extra)
    d = d.withColumns({c: F.lit("own") for c in ("_mix_hash", "_text_hash", "_gonedoc_id", "weight", "before")})
    kept = keep_mixed(d, labels, {"good": None, "low": None, "toxic": 0.0})
    assert kept.columns == d.columns and kept.where("_mix_hash = 'own' AND _text_hash = 'own'").count() == kept.count()
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [*(i for i, k in truth.items() if k != "toxic"), 900, 901, 902, None, 903, 903]))


def test_toxic_words_count_with_punctuation_around_them(spark, docs):
    extra = [(910, "vile### the&&& slur$$$ of%%% hate,"), (911, "(vile) of### slur!! the### hate###"), (912, "the### of### w1### w2###"), (913, '"vile|slur|hate"')]
    d, labels, truth = tables(spark, docs, extra)
    rows = {r["doc_id"]: r for r in mix_documents(d, labels, TARGETS).collect()}
    assert all(rows[i]["p_toxic"] > 0.5 and rows[i]["rate"] < 0.5 for i in (910, 911, 913)) and rows[912]["p_low"] > 0.5
    assert [rows[i]["tokens"] for i in (910, 911, 912, 913)] == [5, 5, 4, 1]
    kept = {r["doc_id"] for r in keep_mixed(d, labels, {"good": None, "low": None, "toxic": 0.0}).collect()}
    assert kept == {*(i for i, k in truth.items() if k != "toxic"), 912}


def test_empty(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert mix_documents(docs([]), none, TARGETS).collect() == []
    got = mix_documents(docs([(1, "a b"), (2, None)]), none, TARGETS).collect()
    assert {(r["doc_id"], r["tokens"]) for r in got} == {(1, 2), (2, 0)}
    assert all(abs(r["p_good"] - 1 / 3) < 1e-3 for r in got)  # posteriors have three digits


def test_only_labelled_texts_are_split_to_learn_from(spark, docs, monkeypatch):
    import re

    from citeloom.llm import mixing

    texts = ["", None, " \t\r\n\x0b\x0c", "a", "a b", "A b\tc a  b c d", "x$1 $1y \\d+ (é—ß)### a.b.c  ..  'tis \x1c \x85 ", "vile###,### vile ###", "one two three two three four " * 30]
    frame = docs(list(enumerate(texts)))
    labelled = spark.createDataFrame([(i, "good") for i in range(len(texts))], "doc_id long, domain string")
    monkeypatch.setattr(mixing, "written", lambda df, name: df)
    got = mixing.labelled_texts(frame, labelled, ("good",))
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "split(" not in below and "regexp" not in below  # the join comes before the work on a text
    whole = ["".join(c.lower() if c.isascii() else c for c in t) for t in texts[3:]]
    words = [[w for w in re.split("[ \t-\r]+", t) if w] for t in whole]
    want = sorted(sorted(dict.fromkeys(re.findall(r"[!-/:-@\[-`{-~]+|[^ \t-\r!-/:-@\[-`{-~]+", " ".join(w)))) for w in words)
    assert sorted(sorted(r["features"]) for r in got.collect()) == want
    slices = spark.createDataFrame([(w,) for w in words], "words array<string>")
    threes = "array_min(transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(slice(words, i + 1, 3))))"
    assert slices.where(F.expr(threes) != mixing._family(F.col("words"))).count() == 0
