import random

from citeloom.llm.tiling import contamination, keep_clean, tile

TESTS = "item_id long, text string, doc_id string, row string"


def greedy(text, test, shortest):
    """Textbook form: longest common run of free words, again and again."""
    free_a, free_b, tiles = [True] * len(text), [True] * len(test), []
    while True:
        best = None
        for p in range(len(text)):
            for q in range(len(test)):
                n = 0
                while p + n < len(text) and q + n < len(test) and free_a[p + n] and free_b[q + n] and text[p + n] == test[q + n]:
                    n += 1
                if n >= shortest and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return tiles
        p, q, n = best
        free_a[p: p + n] = [False] * n
        free_b[q: q + n] = [False] * n
        tiles.append(best)


def test_tiles_equal_the_textbook_form():
    draw = random.Random(2)
    for _ in range(60):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(30))] for _ in range(2))
        pairs = [(p, q) for p in range(len(a) - 2) for q in range(len(b) - 2) if a[p: p + 3] == b[q: q + 3]]
        assert tile(pairs, 3) == greedy(a, b, 3)


def test_copies_and_reordered_passages_are_found(spark, docs):
    draw = random.Random(4)
    items = [[f"t{i}x{draw.randrange(500)}" for _ in range(40)] for i in range(6)]
    tests = spark.createDataFrame([(i, " ".join(w), "d", "r") for i, w in enumerate(items)] + [(10, None, "d", "r"), (11, "too short", "d", "r"), (None, "n " * 20, "d", "r"), (12, "", "d", "r")], TESTS)
    fill = " ".join(f"f{i}" for i in range(100))
    parts = [" ".join(items[1][k: k + 8]) for k in (32, 16, 0, 24, 8)]
    rows = [(0, f"{fill} {' '.join(items[0]).upper()}! {fill}"), (1, f" ... {fill} ".join(parts)), (2, fill), (3, " ".join(items[2][:12])),
            (4, None), (5, ""), (6, f"{', '.join(items[3])} and {' '.join(items[4])}"), (None, " ".join(items[5])), (7, "too short"),
            (8, "n " * 20), (9, (" ".join(items[0]) + " ") * 300), (9, "clean row of the same id")]
    got = {}
    for r in contamination(docs(rows), tests).collect():
        got.setdefault(r["doc_id"], []).append((r["contaminated"], r["n_items"], r["item_id"], r["coverage"]))
    no = (False, 0, None, None)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {
        0: [(True, 1, 0, 1.0)], 1: [(True, 1, 1, 1.0)], 2: [no], 3: [no], 4: [no], 5: [no], 6: [(True, 2, 3, 1.0)], None: [(True, 1, 5, 1.0)], 7: [no],
        8: [no], 9: [no, (True, 1, 0, 1.0)]}
    kept = keep_clean(docs(rows), tests)
    assert kept.columns == docs(rows).columns and sorted({r["doc_id"] for r in kept.collect()}) == [2, 3, 4, 5, 7, 8, 9]


def test_empty(spark, docs):
    none = spark.createDataFrame([], TESTS)
    assert [r["contaminated"] for r in contamination(docs([(1, "a b c d e f")]), none).collect()] == [False]
    some = spark.createDataFrame([(1, "a b c d e", "d", "r")], TESTS)
    assert contamination(docs([]), some).collect() == []


def test_what_text_and_test_repeat_is_not_multiplied_out(spark, docs):
    import tracemalloc

    import numpy as np

    from citeloom.llm.tiling import coverages, tile_hits

    draw = random.Random(6)
    for _ in range(60):
        a, b = ([draw.choice("ab") for _ in range(draw.randrange(40))] for _ in range(2))
        windows = {tuple(a[p: p + 3]) for p in range(len(a) - 2)} & {tuple(b[q: q + 3]) for q in range(len(b) - 2)}
        hits = [tuple(np.array([k for k in range(len(x) - 2) if tuple(x[k: k + 3]) == w]) for x in (a, b)) for w in sorted(windows)]
        assert tile_hits(hits, 3) == greedy(a, b, 3)
    long = np.arange(40_000)
    tracemalloc.start()
    assert tile_hits([(long, np.arange(97))], 4) == [(0, 0, 100)]
    assert tracemalloc.get_traced_memory()[1] < 20_000_000  # 3,880,000 pairs
    tracemalloc.stop()
    tests = spark.createDataFrame([(1, "of the " * 30, "d", "r"), (2, "n " * 50, "d", "r"), (2, "n " * 50, "d", "r")], TESTS)
    rows = [(0, "Of the, " * 20_000), (1, "n " * 20_000), (2, "n " * 7), (3, "of the of the x")]
    texts, tiled = coverages(docs(rows), tests)
    ids = {r["row"]: r["doc_id"] for r in texts.collect()}
    assert {(ids[r["row"]], r["item_id"], r["n_test"], r["covered"], r["tiles"]) for r in tiled.collect()} == {(0, 1, 60, 60, 1), (1, 2, 50, 50, 1), (2, 2, 50, 7, 1), (3, 1, 60, 4, 1)}
