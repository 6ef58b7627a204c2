import random

from citeloom.llm.components import components
from citeloom.llm.neardup import keep_one, least_matches, near_duplicates


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d, d == (low.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(draw, words, n):
    w = list(words)
    for _ in range(n):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10 ** 6)}"
    return w


def cases():
    draw = random.Random(11)
    rows = []
    for _ in range(15):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(8, 200))]
        for _ in range(draw.randrange(1, 6)):
            rows.append(" ".join(edited(draw, base, draw.randrange(0, 1 + len(base) // 20))))
    # a large group of copies, many of them just below or above the threshold
    base = [f"g{i}" for i in range(150)]
    rows += [" ".join(edited(draw, base, draw.randrange(2, 14))) for _ in range(150)]
    rows += ["one two", "ONE  two", "", " \n", "w " * 4000, "w " * 5, "a b c d e", "a b c d e f"]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_equals_all_pairs(spark, docs):
    rows = cases() + [(900, None), (None, "one two"), (None, "lonely words here"), (901, "x y"), (901, "ONE two")]
    got = sorted(map(tuple, near_duplicates(docs(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_keeps_one_of_each_group(spark, docs):
    rows = cases()
    kept = keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_pruning_keeps_pairs_at_the_threshold():
    least = least_matches(10, 30, 75, 1e-6)
    n = [(k + 1) * 30 for k in range(10)]
    assert all(0.75 * x - 7 * (x * 0.1875) ** 0.5 < m < 0.75 * x for x, m in zip(n, least, strict=True) if x > 60)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_empty(spark, docs):
    assert near_duplicates(docs([])).collect() == []
    assert [tuple(r) for r in near_duplicates(docs([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
