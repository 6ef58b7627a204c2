import math
import random

from citeloom.llm.topk import divisible, quantised, search

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string, rank string, dim string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "q", "r", "d", "b") for i, v in rows], SCHEMA)


def brute(rows, k, step):
    good = [(i, [math.floor(x * 256) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in sorted(good, reverse=True) if i % step == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_all_scores(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.5, -0.25, 0.0, 0.125, 0.5, draw.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[i % 4][1]) for i in range(60)]  # ties
    rows = [(i, [float(x) for x in __import__("numpy").array(v, "float32")]) for i, v in rows]
    v = quantised(frame(spark, rows))
    got = sorted(map(tuple, search(v, divisible(v, 20), 5, block_rows=100, query_rows=7).collect()))
    assert got == brute(rows, 5, 20)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []),
            (8, [-0.5, -1.0]), (50, [0.0, 0.0]), (100, [2.0]), (150, [])]
    v = quantised(frame(spark, rows))
    got = sorted(map(tuple, search(v, divisible(v), 5).collect()))
    assert got == brute(rows, 5, 50)
    assert (0, 1, 1, 256 * 128 + 128 * 64) in got and (150, 1, 7, 0) in got


def test_empty(spark):
    v = quantised(frame(spark, []))
    assert search(v, divisible(v)).collect() == []
