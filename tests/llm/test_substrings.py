import hashlib
import random

import pyarrow as pa

from citeloom.llm.substrings import digests, pack, remove_repeats, repeated_windows, unpack

WIDTH = 13


def brute(rows, width=WIDTH):
    words = [(t or "").replace("\x0b", " ").replace("\x0c", " ").split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            k = tuple(w[i: i + width])
            first[k] = min(first.get(k, float("inf")), float("inf") if d is None else d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i: i + width])] < (float("inf") if d is None else d):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_all_windows(spark, docs):
    draw = random.Random(5)
    passages = [[f"w{draw.randrange(40)}" for _ in range(draw.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(draw.randrange(4)):
            w += draw.choice(passages) if draw.random() < 0.6 else [f"w{draw.randrange(5)}" for _ in range(draw.randrange(40))]
        rows.append((i, draw.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "é " * 12), (204, "é " * 13), (205, "é " * 30), (None, "é " * 14), (None, "é " * 20),
             (206, "z " * 5000), (3, "y " * 40), (3, "y " * 20), (4, "y " * 30), (3, "y " * 40), (207, "z" * 5000), (-5, rows[7][1])]
    got = digests(remove_repeats(docs(rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_kept_text(spark, docs):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a {passage} b"), (2, f"c {passage} d")]
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in remove_repeats(docs(rows)).collect()}
    assert got == {1: f"a {passage} b", 2: "c d"}


def test_colliding_hashes_are_told_apart(monkeypatch):
    import numpy as np

    from citeloom.llm import substrings

    monkeypatch.setattr(substrings, "window_hashes", lambda h, width, seed=0: np.full(max(0, len(h) - width + 1), 7, np.uint64))
    a, b = b" ".join(b"a%d" % i for i in range(13)), b" ".join(b"b%d" % i for i in range(13))
    blob = pack(np.array([1, 2, 3]), np.array([0, 0, 0]), np.array([0, 4, 9]), [a, b, a])
    assert [x.tolist() for x in unpack(blob)[:3]] == [[1, 2, 3], [0, 0, 0], [0, 4, 9]]
    marks = repeated_windows([blob], WIDTH)
    assert isinstance(marks, pa.RecordBatch) and marks.to_pydict() == {"doc_id": [3], "text_hash": [0], "span_start": [9], "span_words": [1]}


def test_empty(spark, docs):
    assert remove_repeats(docs([])).collect() == []
