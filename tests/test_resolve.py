import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from citeloom.operators import resolve as rs
from citeloom.runtime import written


def norm(s):
    return " ".join(s.lower().split())


def similarity(a, b):
    """Direct statement of the three patterns, else the ratio."""
    short, long = sorted([norm(a), norm(b)], key=len)
    if len(short) >= 2 and long.startswith(short) and not long[len(short):len(short) + 1].isalpha():
        return 1.0
    if len(short) >= 2 and short != long:
        i = long.find(short)
        if i >= 0 and not long[max(i - 1, 0):i].isalpha() and not long[i + len(short):i + len(short) + 1].isalpha():
            return 1.0
    x, y = sorted([a, b], key=len)
    words = [w for w in __import__("re").findall("[A-Za-z]+", y) if w.lower() not in rs.acronym.__globals__["ACRONYM_STOPWORDS"]]
    if len(x) >= 2 and x.isalpha() and len(words) >= 2 and "".join(w[0] for w in words).upper() == x.upper():
        return 1.0
    return SequenceMatcher(None, norm(a), norm(b)).ratio()


def make_names(seed, n):
    rng = random.Random(seed)
    stems = ["bert", "albert", "roberta", "gpt", "wiki text", "english wikipedia", "wikipedia", "squad", "deep neural network", "dnn", "abab", "aaaa", "xlm r"]
    out = set()
    while len(out) < n:
        s = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s) + 1)
            s[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "-", "2", " x", "s"])
        if norm("".join(s)):
            out.add(norm("".join(s)))
    return sorted(out)


def test_name_pairs_equal_all_pairs(spark):
    new, known = make_names(1, 120), make_names(2, 140)

    def frame(xs):
        return spark.createDataFrame([("Method", x, x) for x in xs], "entity_type string, norm string, name string")

    got = {(r.a, r.b): r.score for r in rs.name_pairs(frame(new), frame(known)).collect()}
    want = {(a, b): s for a in new for b in known if a != b and (s := similarity(a, b)) > 0.85}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len([s for s in want.values() if s < 1]) > 10


def test_name_pairs_with_many_edits_anywhere(spark):
    rng = random.Random(8)
    known = ["".join(rng.choices("abcdef", k=rng.randint(18, 60))) for _ in range(60)]

    def edited(name):
        letters = list(name)
        for _ in range(rng.randint(1, max(1, len(name) // 8))):
            at = rng.randrange(len(letters))
            rng.choice([lambda: letters.pop(at), lambda: letters.insert(at, "x"), lambda: letters.__setitem__(at, "y")])()
        return "".join(letters)

    new = sorted({edited(k) for k in known for _ in range(3)})
    known = sorted(set(known))

    def frame(xs):
        return spark.createDataFrame([("Method", x, x) for x in xs], "entity_type string, norm string, name string")

    for floor in (0.6, 0.85):
        got = {(r.a, r.b) for r in rs.name_pairs(frame(new), frame(known), floor).collect()}
        assert got == {(a, b) for a in new for b in known if a != b and similarity(a, b) > floor}
        assert len(got) > 100


def test_probes_of_a_name_are_a_quarter_of_the_squared_edits(spark):
    for size in (20, 80, 120):
        name = "".join(chr(0x4E00 + i) for i in range(size))  # no two substrings are equal
        probes = rs._probed_segments(spark.createDataFrame([("Method", name)], "entity_type string, a string"), "a", 0.85)
        edits = probes.select("own", "other").distinct().select(rs.most_edits(F.col("own") + F.col("other"), 0.85).alias("k")).collect()
        assert 0 < probes.count() <= sum((r.k + 2) ** 2 / 4 for r in edits)


def test_name_pairs_stay_within_a_type(spark):
    a = spark.createDataFrame([("Method", "bert-base", "bert-base")], "entity_type string, norm string, name string")
    b = spark.createDataFrame([("Dataset", "bert", "bert")], "entity_type string, norm string, name string")
    assert rs.name_pairs(a, b).count() == 0


def test_roots_follow_long_chains(spark):
    parents = spark.createDataFrame([(f"k{i:03}", f"k{i - 1:03}") for i in range(1, 60)], "key string, parent string")
    assert {r.root for r in rs.roots(parents).collect()} == {"k000"}


MENTIONS = "name string, entity_type string, seq long"
STORED = "node_id string, entity_type string, name string, is_alias boolean"


def resolved(spark, mentions, stored, **kw):
    rows = rs.resolve(spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(stored, STORED), **kw).collect()
    return {r.name: (r.method, r.node_key) for r in rows}


def test_cascade(spark):
    got = resolved(
        spark,
        [("BERT ", "Method", 1), ("BERT-large", "Method", 2), ("Zeta Net", "Method", 3), ("Zeta Nets", "Method", 4), ("Zeta Nets v2", "Method", 5),
         ("BERT", "Dataset", 6), ("Bidirectional Encoder Representations from Transformers", "Method", 7), ("BERTHA", "Method", 8)],
        [("m1", "Method", "bert", False), ("m2", "Method", "albert", False)],
    )
    assert got["BERT "] == ("exact", "m1") and got["BERT"] == ("none", "new:Dataset:bert")
    assert got["BERT-large"] == ("fuzzy", "m1")
    assert got["Bidirectional Encoder Representations from Transformers"] == ("fuzzy", "m1")
    assert got["BERTHA"][0] == "none"
    assert got["Zeta Net"] == ("none", "new:Method:zeta net")
    assert got["Zeta Nets"] == ("fuzzy", "new:Method:zeta net") and got["Zeta Nets v2"] == ("fuzzy", "new:Method:zeta net")


def test_alias_is_shortlisted_not_exact(spark):
    stored = [("m1", "Method", "GPT", False), ("m1", "Method", "Generative Thing", True)]
    assert resolved(spark, [("generative thing", "Method", 1)], stored)["generative thing"] == ("fuzzy", "m1")
    refused = resolved(spark, [("generative thing", "Method", 1)], stored, confirm=lambda p: p.filter("false"))
    assert refused["generative thing"][0] == "none"


def test_next_candidate_after_a_refusal(spark):
    stored = [("m1", "Method", "resnet50", False), ("m2", "Method", "resnets", False)]
    mention = [("resnet-50", "Method", 1)]
    assert resolved(spark, mention, stored)["resnet-50"] == ("fuzzy", "m1")
    other = resolved(spark, [("resnet", "Method", 1)], stored, confirm=lambda p: p.filter(F.col("b") != "resnet50"))
    assert other["resnet"] == ("fuzzy", "m2")


def test_every_node_of_an_alias_is_a_candidate(spark):
    stored = [("m1", "Method", "Foo", False), ("m1", "Method", "sharednet", True), ("m2", "Method", "Bar", False), ("m2", "Method", "sharednet", True)]
    asked = []

    def second(pairs):
        asked.append(pairs.select("node_id").collect())
        return pairs.filter("node_id = 'm2'")

    assert resolved(spark, [("sharednet2", "Method", 1)], stored)["sharednet2"] == ("fuzzy", "m1")
    assert resolved(spark, [("sharednet2", "Method", 1)], stored, confirm=second)["sharednet2"] == ("fuzzy", "m2")
    assert [[r.node_id for r in x] for x in asked] == [["m1"], ["m2"]]  # in rounds, best first


def test_model_confirms_with_descriptions(spark):
    def model():
        return lambda system, prompt: "Yes." if "a residual one" in prompt and "Second (Method): resnets" in prompt else "no"

    told = spark.createDataFrame([("Method", "resnet", "a residual one")], "entity_type string, norm string, description string")
    stored = [("m1", "Method", "resnet50", False), ("m2", "Method", "resnets", False)]
    got = resolved(spark, [("resnet", "Method", 1), ("resnetz", "Method", 2)], stored, confirm=rs.ask_model([model], told, pause=0))
    assert got["resnet"] == ("fuzzy", "m2") and got["resnetz"] == ("none", "new:Method:resnetz")


def test_candidates_grow_with_matches_only(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11)) for _ in range(3000)]
    frame = spark.createDataFrame([("Method", x) for x in names], "entity_type string, b string")
    keys = ["entity_type", "own", "other", "i", "segment"]
    probes = rs._probed_segments(frame.withColumnRenamed("b", "a"), "a", 0.85)
    assert probes.join(rs._indexed_segments(frame, "b", 0.85), keys).filter("a <> b").select("a", "b").distinct().count() < 0.02 * len(names) ** 2


def test_description_channel(spark):
    stored = spark.createDataFrame([("m1", "Method", "Alpha", [1.0, 0.0]), ("m2", "Method", "Beta", [0.0, 1.0])], "node_id string, entity_type string, name string, vector array<float>")
    vectors = spark.createDataFrame([("Method", "omega", [0.9, 0.1])], "entity_type string, norm string, vector array<float>")
    mentions = spark.createDataFrame([("Omega", "Method", 1), ("Psi", "Method", 2)], MENTIONS)
    got = {r.name: (r.method, r.node_key) for r in rs.resolve(mentions, stored, mention_vectors=vectors, dimension=2).collect()}
    assert got == {"Omega": ("fuzzy", "m1"), "Psi": ("none", "new:Method:psi")}


def test_merge_policy(spark):
    mentions = spark.createDataFrame([("BERT", "Method", 1), ("BERT-b", "Method", 2)], MENTIONS)
    stored = spark.createDataFrame([("m1", "Method", "Bert model", False), ("m1", "Method", "Bidirectional", True)], STORED)
    out = rs.resolve(mentions, stored)
    canonical = rs.merged_entities(out, stored)
    assert {r.node_key: r.name for r in canonical.collect()} == {"m1": "BERT"}
    assert {r.alias for r in rs.alias_rows(out, stored, canonical).collect()} == {"BERT-b", "Bert model", "Bidirectional"}


def test_rounds_grow_with_the_logarithm_of_the_shortlist(spark):
    from citeloom.operators.resolve import first_confirmed

    rows = [("Method", "x", f"m{i}", 1 - i / 100) for i in range(1, 20)] + [("Method", "y", "m1", 0.9), ("Method", "y", "m5", 0.8)]
    pairs = spark.createDataFrame(rows, "entity_type string, a string, node_id string, score double")
    asked = []

    def confirm(part):
        asked.append(part.count())
        return part.filter("node_id IN ('m5', 'm6', 'm19')")

    got = first_confirmed(pairs, confirm, [F.desc("score")])
    assert {(r.a, r.node_id) for r in got.collect()} == {("x", "m5"), ("y", "m5")}
    assert asked == [2, 3, 4]  # ranks 1, 2 to 3, 4 to 7; the rest is never asked about


def test_name_keys_are_not_broadcast_and_unlike_letters_not_compared(spark, monkeypatch):
    rng = random.Random(9)
    names = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(600)]
    frame = spark.createDataFrame([("Method", x, x) for x in names], "entity_type string, norm string, name string")
    plans = []

    def seen(df, name):
        stored = written(df, name)
        if name == "name-pairs":
            plans.append((df._jdf.queryExecution().sparkPlan().toString(), stored.count()))
        return stored

    monkeypatch.setattr(rs, "written", seen)
    changed = frame.select("entity_type", *[F.concat(F.lit("z"), F.substring(c, 2, 31)).alias(c) for c in ("norm", "name")])
    assert rs.name_pairs(changed, frame).count() == 600
    [(plan, candidates)] = plans
    assert plan.count("SortMergeJoin") >= 3 and candidates < 700
