import hashlib
import itertools
import random
import re
import zlib

import pytest

from citeloom.llm.turns import STATES, Spans, closed, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, part int, seat long, cost string"
KINDS = [(i, f) for i in "sua?" for f in ("", "b", "d", "t")]


def least(rows):
    """The least (cost, audit) of all edits, tried one by one, with at most two inserted rows in any place."""
    best = None
    names = {"u": "u", "a": "a"}
    for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
        for edits in itertools.product(("K", "u", "a", "D"), repeat=len(rows)):
            read, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0])
            for (initial, fault), edit, gap in zip(rows, edits, gaps[1:], strict=True):
                if edit == "D":
                    cost, audit = cost + 3, audit + "D"
                else:
                    if fault in "bd" and fault:
                        cost += 10_000
                    cost += (fault == "t") + (0 if edit == "K" else 2)
                    read, audit = read + (initial if edit == "K" else names[edit]), audit + ("K" if edit == "K" else "R")
                read, audit, cost = read + gap, audit + "I" * len(gap), cost + 2 * len(gap)
            if cost < 10_000 and re.fullmatch("(s?(ua)+)?", read) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def parse(rows):
    spans = Spans()
    cells = closed(spans.parse([spans.row(*r) for r in rows]))
    start = {("0", "0"): (0, ""), ("0", "u"): (2, "I"), ("0", "a"): (4, "II")}
    ways = [(c + d, x + y) for (p, q), (c, x) in start.items() for (r, t), (d, y) in cells.items() if q == r and t in "0a"]
    return min(ways)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_spans_give_the_least_edits(length):
    draw = random.Random(length)
    for _ in range(60 if length < 3 else 12):
        rows = [draw.choice(KINDS) for _ in range(length)]
        assert parse(rows) == least(rows)


def test_any_cut_gives_the_same_cells():
    draw = random.Random(4)
    from citeloom.llm.turns import joined

    rows = [Spans().row(*draw.choice(KINDS)) for _ in range(23)]
    whole = Spans().parse(rows)
    for cut in (1, 7, 16, 22):
        assert joined(Spans().parse(rows[:cut]), Spans().parse(rows[cut:])) == whole
    assert {p for p, _ in whole} <= set(STATES)


def expected(rows):
    """Conversations repaired row by row: a pass over states with the least (cost, audit, lines)."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None or role == "" else role, " " if text is None else text
            role = "user" if d == 4 else role
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            left += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:24], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in left:
            solid = re.sub("[ \t-\r]", "", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {t for t, _, _ in left if t is not None}
        illegal = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
        reads = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
        full = {"u": "user", "a": "assistant"}

        def insert(best):
            for _ in range(2):
                for (p, q), k in reads.items():
                    if p in best and k in full:
                        c, a, lines = best[p]
                        new = (c + 2, a + "I", (*lines, full[k] + ":"))
                        best[q] = min(best.get(q, new), new)
            return best

        best = insert({"0": (0, "", ())})
        for (_, role, text), fault in zip(left, faults, strict=True):
            after = {p: (c + 3, a + "D", lines) for p, (c, a, lines) in best.items()}
            if fault not in ("b", "d"):
                for (p, q), k in reads.items():
                    if p in best:
                        c, a, lines = best[p]
                        for sign, cost, name in [*([("K", 0, role)] if role[0] == k else []), *([("R", 2, full[k])] if k in full else [])]:
                            new = (c + cost + (fault == "t"), a + sign, (*lines, f"{name}:{text}"))
                            after[q] = min(after.get(q, new), new)
            best = insert(after)
        cost, audit, lines = min(best[q] for q in ("0", "a") if q in best) if left else (0, "", ())
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal,
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = repair_conversations(df).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


def test_conversations_equal_a_pass_over_states(spark):
    draw = random.Random(11)
    rows = []
    for conv in range(60):
        for turn in range(draw.randrange(1, 9)):
            text = draw.choice(["Yes.", "No!", "", " ", None, "half a", "é ü. ", "long " * 50 + "."]) if draw.random() < 0.5 else f"text {draw.random()}."
            rows.append((conv, draw.choice([turn, turn, turn, turn * 3, None]), draw.choice(["user", "assistant", "system", "tool", "", None]), text))
    rows += [(None, t, "user" if t % 2 else "assistant", f"no id {t}.") for t in range(5)]
    rows += [(700, None, None, None)] * 3 + [(701, 5, "user", "same.")] * 4 + [(702, 0, "assistant", "x" * 200_000 + "?")]
    # a conversation with most of all rows, over all parts
    rows += [(800, t, ("user", "assistant", "user", "assistant", "system")[t % 5], f"turn {t % 90} of many.") for t in range(700)]
    dropped = next(c for c in itertools.count(900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    want = expected(rows)
    assert result(spark, rows) == want
    assert want[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty(spark):
    assert result(spark, []) == {}
