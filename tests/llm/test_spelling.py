import random
import re
import zlib
from collections import Counter

import pytest

from citeloom.llm.spelling import Composition, acceptor, near_words, prefixes, spelling_variants


def one_edit(words):
    known, out = set(words), set()
    for w in known:
        out |= {frozenset((w, x)) for x in (w[:i] + w[i + 1:] for i in range(len(w))) if x in known}
    gaps = {}
    for w in known:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1:]), []).append(w)
    return out | {frozenset((a, b)) for group in gaps.values() for a in group for b in group if a < b}


def random_words(seed, n, letters="abc", least=5, most=11):
    draw = random.Random(seed)
    return {"".join(draw.choice(letters) for _ in range(draw.randrange(least, most))) for _ in range(n)}


def test_composition_accepts_all_pairs_once():
    for seed in range(80):
        words = sorted(random_words(seed, 1 + seed % 40, "ab", 0, 7))
        pairs = list(Composition(words).pairs())
        assert len(pairs) == len(set(map(frozenset, pairs))) and set(map(frozenset, pairs)) == one_edit(words)


def test_acceptor_is_minimal():
    arcs, final, start = acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(arcs) == 5 and final[start] is False
    long = "x" * 50_000
    assert list(Composition([long, long + "x"]).pairs()) == [(long + "x", long)]


@pytest.mark.parametrize("group, depth", [(20_000, 2), (12, 1), (4, 2)])
def test_partitions_give_every_pair_both_ways(spark, group, depth):
    words = random_words(7, 250) | {"abcab", "abcabc", "abcaba", "abcabab", "aaaaa", "aaaaaa", "aaaaaaa"}
    vocab = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [(r["word"], r["near"]) for r in near_words(vocab, group, depth).collect()]
    want = one_edit(words)
    assert len(got) == len(set(got)) == 2 * len(want) and set(map(frozenset, got)) == want
    placed = prefixes(vocab, group, depth)
    assert placed.count() == len(words) and placed.where("depth > length(word)").count() == 0
    assert placed.groupBy(placed.word.substr(placed.depth * 0 + 1, placed.depth)).count().where(f"count > {group}").count() == 0


def expected(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [] for w in n}
    for a, b in map(tuple, one_edit(n)):
        near[a].append(b)
        near[b].append(a)
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items())


def test_texts_equal_brute_force(spark, docs):
    draw = random.Random(5)
    words = sorted(random_words(3, 120, "abé", 4, 8))
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(draw.choices(words, weights, k=60)).title() if i % 3 else "1 ".join(draw.choices(words, weights, k=60))) for i in range(60)]
    rows += [(None, "ababab ababab ababab"), (1, None), (2, ""), (3, "ÀÖ×÷ÿÿ " * 3), (4, ("z" * 3_000 + " ") * 3 + "z" * 2_999 + " " + ("z" * 2_999 + "y ") * 3), (5, "ababab"), (5, "ababab"), (6, "kkkkk " * 3 + "kkkkkx " * 7 + "kkkkkxy " * 16)]
    got = sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling_variants(docs(rows)).collect())
    want = expected(rows)
    assert got == want and sum(r[1] is not None for r in want) > 10 and any(r[2] != r[1] for r in want if r[1])


def test_empty(docs):
    assert spelling_variants(docs([])).collect() == [] and spelling_variants(docs([(1, "ab cd")])).collect() == []
