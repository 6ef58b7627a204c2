import math
import random
from collections import Counter

import numpy as np

from citeloom.llm.langid import Letters, identify, keep_identified, kneser_ney, sequences, windows

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["zür", "gen", "sch", "ein"], "cc": ["оно", "дви", "жа", "ет"]}


def corpus(draw, n):
    out = []
    for i in range(n):
        lang = draw.choice(sorted(SYLLABLES))
        words = ["".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(8, 60))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def test_models_equal_the_recursive_definition():
    texts = ["ab abc", "abba", "cab b"]
    letters, order = Letters(), 3
    ids, counts = sequences(texts, letters)
    rows = windows(ids, counts, order).astype(np.int64)
    grams = Counter(zip(*rows.tolist(), strict=True))
    chars, n = np.array(list(grams)).T, np.array(list(grams.values()))
    models = kneser_ney(np.zeros(len(n), np.int64), chars, n, ["x"])
    full = {g[::-1]: c for g, c in grams.items()}  # oldest character first
    levels = {order: full}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    known = len({g[-1] for g in full})

    def p(gram):
        if not gram:
            return 1 / (known + 1)
        table = levels[len(gram)]
        n1, n2 = (sum(c == k for c in table.values()) for k in (1, 2))
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + 2 * n2 else 0.5
        after = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        whole = sum(after.values())
        return max(table.get(gram, 0) - d, 0) / whole + d * len(after) / whole * p(gram[1:])

    probe = ["abc ba", "zab", "", "cc!a"]
    ids, counts = sequences(probe, letters)
    got = models.logs(windows(ids, counts, order))[:, 0]
    want = [math.log2(p(tuple(g[::-1]))) for g in windows(ids, counts, order).T.tolist()]
    assert np.allclose(got, want, atol=1e-4)
    assert math.isclose(sum(p((*map(ord, "ab"), c)) for c in [*{g[-1] for g in full}, 999]), 1.0, rel_tol=1e-9)


def test_languages_of_held_out_texts(spark, docs):
    draw = random.Random(1)
    rows = corpus(draw, 240)
    noise = ["".join(chr(draw.randrange(0x1400, 0x1600)) for _ in range(300)) for _ in range(3)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !? \n", None), (1003, noise[0], None), (None, "kalomi tutu mika lolo", "bb"), (1004, noise[1] * 50, "aa"),
           (1005, "kalo " * 20_000, None), (7, "gensch einzür gen gen einein", None)]
    got = identify(docs(rows + odd)).collect()
    assert len(got) == len(rows + odd)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 7}
    truth = {i: lang for i, _, lang in rows if i != 7}
    assert all(by_id[i]["lang_pred"] == lang and not by_id[i]["rejected"] for i, lang in truth.items())
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, None, 1005)] == ["und", "und", "und", "aa", "aa"]
    assert all(by_id[i]["rejected"] for i in (1000, 1001, 1002, 1003, 1004)) and not by_id[1005]["rejected"]
    assert by_id[1003]["lang_pred"] in SYLLABLES and all(0 <= r["score"] <= 1 for r in got)
    kept = keep_identified(docs(rows + odd))
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {*truth, 7, 1005, None}


def test_texts_of_a_language_without_labels_are_rejected(spark, docs):
    rows = corpus(random.Random(4), 300)
    other = ["ta", "ko", "li", "mu", "ger", "zen"]  # letters of the known languages in other syllables
    draw = random.Random(5)
    rows += [(2000 + i, " ".join("".join(draw.choice(other) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(20, 60))), None) for i in range(20)]
    got = identify(docs(rows)).collect()
    assert all(r["rejected"] == (r["doc_id"] >= 2000) for r in got)


def test_a_label_of_its_own_row_is_no_input(spark, docs):
    rows = corpus(random.Random(2), 120)
    held = {r["doc_id"] for r in identify(docs(rows)).where("held_out").collect()}
    changed = [(i, t, "aa" if i in held else lang) for i, t, lang in rows]
    pick = ["doc_id", "lang_pred", "score"]
    assert identify(docs(rows)).select(pick).orderBy("doc_id").collect() == identify(docs(changed)).select(pick).orderBy("doc_id").collect()


def test_empty_and_unlabelled(spark, docs):
    assert identify(docs([])).collect() == []
    assert [tuple(r)[2:4] for r in identify(docs([(1, "some text")])).collect()] == [("und", 0.0)]
