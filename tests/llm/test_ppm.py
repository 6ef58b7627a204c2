import math
import random
import re
import zlib
from collections import Counter, defaultdict

from citeloom.llm import ppm
from citeloom.llm.ppm import score_documents


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def trie(texts, order):
    seen = defaultdict(Counter)
    for t in texts:
        s = b"\xff" * order + t + b"\xff"
        for i in range(order, len(s)):
            for j in range(order + 1):
                seen[s[i - j: i]][s[i]] += 1
    return seen


def log_probability(text, seen, order):
    s, out = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        for j in range(order, -1, -1):
            counts = {k: n for k, n in seen.get(s[i - j: i], {}).items() if k not in excluded}
            if not counts:
                continue
            whole = sum(counts.values()) + len(counts)
            if s[i] in counts:
                p *= counts[s[i]] / whole
                break
            p *= len(counts) / whole
            excluded |= set(counts)
        else:
            p /= 256 - len(excluded)
        out += math.log10(p)
    return out


def rows():
    draw = random.Random(8)
    out = [(i, " ".join(draw.choice(["the", "Theme", "of", "offer", "été", "x1", "zz"]) for _ in range(draw.randrange(25)))) for i in range(60)]
    return out + [(100, None), (101, ""), (102, "unseen Ωmega \x00 bytes"), (None, "no id"), (103, "q" * 3000), (5, "again"), (5, "again")]


def by_hand(table, order):
    texts = [(d, lowered(t)) for d, t in table]
    seen = trie([t for d, t in texts if not held(d)], order)
    words = Counter()
    for d, t in texts:
        if not held(d):
            words.update([*re.findall(rb"[^\x20\x09-\x0d]+", t), None])
    n, v, out = sum(words.values()), len(words), []
    for d, t in texts:
        tokens = [*re.findall(rb"[^\x20\x09-\x0d]+", t), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((d, held(d), len(tokens), sum(words[w] > 0 for w in tokens), n, round(base, 6), round(log_probability(t, seen, order), 6)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect()), key=repr)


def test_equals_the_definition(spark, docs):
    assert result(score_documents(docs(rows()), order=3)) == by_hand(rows(), 3)


def test_split_trie_gives_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm, "COMMON", 4)  # most words take the way of the rare ones
    assert result(score_documents(docs(rows()), order=2, model_grams=30)) == by_hand(rows(), 2)


def test_empty_and_nothing_to_learn_from(spark, docs):
    assert score_documents(docs([])).collect() == []
    d = next(i for i in range(50) if held(i))
    (r,) = score_documents(docs([(d, "ab")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0)
    assert abs(r["score"] + 3 * math.log10(256)) < 1e-9
