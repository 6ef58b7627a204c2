import itertools
import random

import pytest

from citeloom.llm.tokens import VOCABULARY, by_ending, count_tokens, load_vocabulary, token_counts


def all_ways(word, pieces, byte_log):
    """The best (score, -tokens) over every segmentation."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[start:i])
                start = i
        score, n = 0.0, 0
        for p in parts:
            if p in pieces:
                score, n = score + pieces[p], n + 1
            elif len(p) == 1:
                score, n = score + len(p.encode()) * byte_log, n + len(p.encode())
            else:
                break
        else:
            if best is None or (round(score, 9), -n) > best:
                best = (round(score, 9), -n)
    return -best[1]


PIECES = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -3.0, "ab": -3.5, "ba": -4.0, "abab": -5.0, "bab": -5.5, "▁ab": -4.0}


def test_equals_all_segmentations():
    draw = random.Random(6)
    words = sorted({"▁" + "".join(draw.choice("abcé") for _ in range(draw.randrange(9))) for _ in range(150)})
    assert count_tokens(words, by_ending(PIECES), -9.0) == [all_ways(w, PIECES, -9.0) for w in words]


def test_documents(spark, docs):
    rows = [(1, "ab ab\nabab"), (2, None), (3, ""), (4, " \t "), (None, "ab"), (5, "a" * 3000), (6, "ab " * 3000), (7, "ab"), (7, "ab")]
    table = by_ending(PIECES)
    one = dict(zip(["▁ab", "▁abab"], count_tokens(["▁ab", "▁abab"], table, min(PIECES.values()) - 10), strict=True))
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts(docs(rows), PIECES).collect()}
    assert got == {(1, 3, 2 * one["▁ab"] + one["▁abab"]), (2, 0, 0), (3, 0, 0), (4, 0, 0), (None, 1, one["▁ab"]), (5, 1, 3000), (6, 3000, 3000 * one["▁ab"]), (7, 1, one["▁ab"])}
    assert token_counts(docs([]), PIECES).collect() == []


def test_vocabulary_file(spark, docs):
    pytest.importorskip("sentencepiece")
    if not __import__("os").path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    pieces = load_vocabulary()
    assert len(pieces) > 30_000 and max(pieces.values()) < 0
    (r,) = token_counts(docs([(1, "the and of")])).collect()
    assert (r["n_words"], r["n_tokens"]) == (3, 3)
