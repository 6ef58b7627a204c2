"""Repair of conversations by weighted interval parsing.

A conversation should read (s?(ua)+)? by the initials of its roles. The grammar's
nonterminals are pairs of what may have been read before and after a span: ``0``
nothing, ``s``, ``u`` and ``a`` the role before. In Chomsky normal form a pair (p, q)
becomes (p, r)(r, q) over two spans, or one row kept, re-roled or deleted; inserted
rows are closed over between spans. A cell is the least (cost, audit).

Every cut of a span gives the same least cells, as a derivation of (p, q) passes
some state at each row. So spans are combined bottom-up by length 1, 2, 4, ...,
once each instead of at all cuts, and a conversation of any length is parsed in
segments whose cells combine in turn. Of two audits of one span and equal cost none
starts with the other (what follows would be inserts, which cost), so least strings
stay least when they are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import written

# Fixed values of the task.
KEEP, REROLE, DELETE, INSERT, OPEN = 0, 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
READS = {"s": [("0", "s")], "u": [("0", "u"), ("s", "u"), ("a", "u")], "a": [("u", "a")]}
ENDS = ("0", "a")
INSERTS = {("0", "u"): 1, ("0", "a"): 2, ("s", "u"): 1, ("s", "a"): 2, ("u", "a"): 1, ("a", "u"): 1}

STATES = "0sua"
BLANK, AGAIN, TRUNCATED = "b", "d", "t"
TIE = 24  # characters of a text that order rows of one turn and role, before its digest

Cell = tuple[int, str]
Cells = dict[tuple[str, str], Cell]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that the CRC-32 of ``conv_id:turn`` names.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes out its marks of
    sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space; so is an
    empty role, which has no initial.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    d = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    text = shown("text")
    role = F.when(d == 4, "user").when(shown("role") == "", " ").otherwise(shown("role"))
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return (conversations.where(d != 0)
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(d == 3, 2).otherwise(1).cast("long").alias("copies")))


def _tie(text: Column) -> Column:
    return F.concat(F.substring(text, 1, TIE), F.sha2(text.cast("binary"), 256))


def judged(turns: DataFrame) -> DataFrame:
    """One light row per different (conv_id, turn, role, text), without the text: its copies and faults.

    ``tie`` stands for the text: its first characters and digest. Copies and repeats
    are counted by aggregates, so rows that repeat often meet nowhere as rows.
    """
    text = F.col("text")
    fault = (F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), BLANK).when(~text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), TRUNCATED).otherwise(""))
    light = (turns.select("conv_id", "turn", "role", _tie(text).alias("tie"), fault.alias("fault"), "copies")
             .groupBy("conv_id", "turn", "role", "tie", "fault").agg(F.sum("copies").alias("copies")))
    light = written(light, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = light.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("tie").alias("_tie")).agg(F.min(order).alias("_first"))
    joined = light.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("tie") == F.col("_tie")))
    return joined.select("conv_id", "turn", "role", "tie", "fault", "copies", (order > F.col("_first")).alias("again"))


def leaf(initial: str, fault: str) -> Cells:
    """Cells of a span of one row."""
    cells: Cells = {(p, p): (DELETE, "D") for p in STATES}
    if fault not in (BLANK, AGAIN):
        left = OPEN if fault == TRUNCATED else 0
        for kind, moves in READS.items():
            for move in moves:
                if kind == initial:
                    _offer(cells, move, (KEEP + left, "K"))
                if kind in NAMES:
                    _offer(cells, move, (REROLE + left, "R"))
    return cells


def _offer(cells: Cells, move: tuple[str, str], cell: Cell) -> None:
    if move not in cells or cell < cells[move]:
        cells[move] = cell


def closed(cells: Cells) -> Cells:
    """The span followed by any inserted rows."""
    out = dict(cells)
    for (p, q), (cost, audit) in cells.items():
        for (a, b), n in INSERTS.items():
            if a == q:
                _offer(out, (p, b), (cost + n * INSERT, audit + "I" * n))
    return out


def joined(left: Cells, right: Cells) -> Cells:
    """Two neighbouring spans as one, with rows inserted between them."""
    out: Cells = {}
    for (p, r), (cost, audit) in closed(left).items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                _offer(out, (p, q), (cost + more, audit + rest))
    return out


class Spans:
    """Combines rows bottom-up; short spans of the same rows are combined once."""

    MEMO = 100_000

    def __init__(self) -> None:
        self.leaves: dict[tuple[str, str], Cells] = {}
        self.short: dict[tuple[int, int], tuple[Cells, Cells, Cells]] = {}

    def row(self, initial: str, fault: str) -> Cells:
        key = (initial if initial in READS else " ", fault)
        if key not in self.leaves:
            self.leaves[key] = leaf(*key)
        return self.leaves[key]

    def parse(self, rows: list[Cells]) -> Cells:
        level, width = rows, 1
        while len(level) > 1:
            pairs = [self._two(level[i], level[i + 1], width) for i in range(0, len(level) - 1, 2)]
            level, width = pairs + level[len(pairs) * 2:], width * 2
        return level[0]

    def _two(self, left: Cells, right: Cells, width: int) -> Cells:
        if width > 4:
            return joined(left, right)
        # cells are told apart by identity; the memo keeps them alive
        key = (id(left), id(right))
        if key not in self.short:
            if len(self.short) >= self.MEMO:
                return joined(left, right)
            self.short[key] = (joined(left, right), left, right)
        return self.short[key][0]


_MOVES = [(p, q) for p in STATES for q in STATES]
_SEGMENT = ("conv_id long, part int, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
            "first_role string, last_role string, costs array<long>, audits array<string>")
_SEATED = "conv_id long, turn long, role string, tie string, copies long, part int, seat long, segment struct<" + ", ".join(x.replace(" ", ": ", 1) for x in _SEGMENT.split(", ")[2:]) + ">"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def seated(rows: DataFrame) -> DataFrame:
    """The judged rows in order, with ``part`` and ``seat``; the last of a conversation in a part carries the segment's cells.

    Conversations are dealt in order by range, so one that holds most rows is parsed in
    as many segments as it has parts.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "tie"]
    dealt = rows.select(*order, "fault", "again", "copies").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, spans = TaskContext.get().partitionId(), Spans()
        segment = pa.struct([("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                             ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
                             ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()), ("copies", pa.int64()),
                            ("part", pa.int32()), ("seat", pa.int64()), ("segment", segment)])
        out: list[tuple] = []
        held: tuple | None = None  # the row before, which may be the last of its segment
        sums: dict = {}
        rows: list[Cells] = []

        def close() -> None:
            if held is not None:
                cells = spans.parse(rows)
                out.append((*held, sums | {"costs": [cells[m][0] if m in cells else None for m in _MOVES], "audits": [cells[m][1] if m in cells else None for m in _MOVES]}))

        for batch in batches:
            for conv, turn, role, tie, fault, again, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv != held[0]:
                    close()
                    held, rows = None, []
                    sums = {"first_turn": None, "last_turn": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                            "first_role": role[0], "last_role": None}
                if held is not None:
                    out.append((*held, None))
                if turn is not None and turn != sums["last_turn"]:
                    sums["first_turn"] = turn if sums["first_turn"] is None else sums["first_turn"]
                    sums["last_turn"], sums["turns"] = turn, sums["turns"] + 1
                if sums["last_role"] is not None and sums["last_role"] + role[0] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                sums["illegal"] += copies - 1
                sums["last_role"] = role[0]
                held = (conv, turn, role, tie, copies, part, len(rows))
                # of equal rows all but the first are repeats
                one = BLANK if fault == BLANK else AGAIN if again else fault
                rest = BLANK if fault == BLANK else AGAIN
                for name, x in (("blank", BLANK), ("duplicate", AGAIN), ("truncated", TRUNCATED)):
                    sums[name] += (one == x) + (copies - 1) * (rest == x)
                rows.append(spans.row(role[0], one))
                rows.extend([spans.row(role[0], rest)] * (copies - 1))
                if len(out) >= 10_000:
                    yield _batch(out, schema)
                    out.clear()
        close()
        if out:
            yield _batch(out, schema)

    return written(dealt.mapInArrow(segments, _SEATED), "seated-turns")


def parsed(seats: DataFrame) -> DataFrame:
    """One row per segment: where its reading starts and its edits; the last one of a conversation has its sums as well.

    The cells of a conversation's segments are read in order as a stream; there are
    at most as many segments as parts.
    """
    segments = (seats.where(F.col("segment").isNotNull()).select("conv_id", "part", "segment.*")
                .repartition("conv_id").sortWithinPartitions("conv_id", "part"))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("state", pa.string()), ("edits", pa.string()), ("last", pa.bool_()), ("gaps", pa.int64()),
                        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, some = None, False
        best: dict[str, Cell] = {}
        ways: list[tuple[int, dict[str, tuple[str, str]]]] = []  # per segment and end state: start state and edits
        sums: dict = {}

        def close() -> Iterator[pa.RecordBatch]:
            if not some:
                return
            state = min((q for q in ENDS if q in best), key=lambda q: best[q])
            cost, audit = best[state]
            gaps = sums["last_turn"] - sums["first_turn"] + 1 - sums["turns"] if sums["turns"] else 0
            rows: list[tuple] = []
            for n, (part, way) in enumerate(reversed(ways)):
                state, edits = way[state]
                tail = (gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, audit) if n == 0 else (None,) * 7
                rows.append((conv, part, state, edits, n == 0, *tail))
            yield _batch(rows, schema)

        for batch in batches:
            for row in batch.to_pylist():
                cells = {m: (c, a) for m, c, a in zip(_MOVES, row["costs"], row["audits"], strict=True) if c is not None}
                if not some or row["conv_id"] != conv:
                    yield from close()
                    conv, some, ways = row["conv_id"], True, []
                    sums = row
                    # rows may be inserted before the first one
                    opened = {q: ("0", "I" * n) for q, n in [("0", 0), *((b, n) for (a, b), n in INSERTS.items() if a == "0")]}
                    best = {q: (len(i) * INSERT, i) for q, (_, i) in opened.items()}
                else:
                    opened = {q: (q, "") for q in best}
                    last, first = sums["last_turn"], row["first_turn"]
                    sums = sums | {k: sums[k] + row[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {
                        "turns": sums["turns"] + row["turns"] - (last is not None and last == first),
                        "first_turn": first if sums["first_turn"] is None else sums["first_turn"],
                        "last_turn": last if row["last_turn"] is None else row["last_turn"], "last_role": row["last_role"],
                        "illegal": sums["illegal"] + row["illegal"] + (sums["last_role"] + row["first_role"] not in ("su", "ua", "au"))}
                following: dict[str, tuple[Cell, str, str]] = {}
                for (p, q), (cost, audit) in closed(cells).items():
                    if p in best:
                        start, before = opened[p]
                        whole = (best[p][0] + cost, best[p][1] + audit)
                        if q not in following or whole < following[q][0]:
                            following[q] = (whole, start, before + audit)
                best = {q: x[0] for q, x in following.items()}
                ways.append((row["part"], {q: (start, edits) for q, (_, start, edits) in following.items()}))
        yield from close()

    return written(segments.mapInArrow(fold, "conv_id long, part int, state string, edits string, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "parsed-segments")


def repaired(turns: DataFrame, seats: DataFrame, segments: DataFrame) -> DataFrame:
    """(conv_id, part, at, edit, turn, role, text) of the rows that stay or are inserted, in order of (part, at).

    Edits are dealt to light rows segment by segment; the texts of kept rows join by
    what names a row, so those of one conversation are spread over all tasks.
    """
    marks = segments.select("conv_id", "part", F.lit(-1).cast("long").alias("seat"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                            F.lit(None).cast("string").alias("tie"), F.lit(None).cast("long").alias("copies"), "state", "edits")
    rows = seats.select("conv_id", "part", "seat", "turn", "role", "tie", "copies", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("edits"))
    dealt = marks.unionByName(rows).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "seat")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("was", pa.string()),
                        ("tie", pa.string()), ("role", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, edits, at, conv, part = "0", "", 0, None, None
        out: list[tuple] = []

        def insert() -> None:
            nonlocal state, at
            while at < len(edits) and edits[at] == "I":
                state = "a" if state == "u" else "u"
                out.append((conv, part, at, "I", None, None, None, NAMES[state]))
                at += 1

        for batch in batches:
            for c, p, seat, turn, role, tie, copies, start, given in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if seat < 0:
                    insert()
                    conv, part, state, edits, at = c, p, start, given, 0
                    continue
                for _ in range(copies):
                    insert()
                    if edits[at] == "K":
                        state = role[0]
                        out.append((c, p, at, "K", turn, role, tie, role))
                    elif edits[at] == "R":
                        state = "a" if state == "u" else "u"
                        out.append((c, p, at, "R", turn, role, tie, NAMES[state]))
                    at += 1
            # rows inserted after the last row of a segment follow with the next mark
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        insert()
        if out:
            yield _batch(out, schema)

    steps = written(dealt.mapInArrow(walk, "conv_id long, part int, at long, edit string, turn long, was string, tie string, role string"), "turn-edits")
    # rows that repeat one another stay at most once: one text each
    texts = turns.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), _tie(F.col("text")).alias("_tie"), "text").where("copies > 0")
    names = (F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("was") == F.col("_role")) & (F.col("tie") == F.col("_tie")))
    kept = steps.where("edit <> 'I'").join(texts, names).select("conv_id", "part", "at", "edit", "turn", steps["role"], "text").dropDuplicates(["conv_id", "part", "at"])
    new = steps.where("edit = 'I'").select("conv_id", "part", "at", "edit", "turn", "role", F.lit("").alias("text"))
    return kept.unionByName(new)


def hashed(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines in order; a conversation's texts pass a digest one by one."""
    dealt = rows.select("conv_id", "part", "at", F.concat_ws(":", "role", "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []
        for batch in batches:
            for c, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        if state is not None:
            out.append((conv, state.hexdigest()))
        if out:
            yield _batch(out, schema)

    return dealt.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults, cost and audit per conversation of (conv_id, turn, role, text, copies), and the repaired rows.

    Rows are read by turn, nulls first; rows of one turn by role, then by the first
    characters and the digest of the text. A null conv_id is a conversation too. Rows
    that repeat another of their conversation, and blank ones, are deleted.
    """
    seats = seated(judged(turns))
    segments = parsed(seats)
    return segments.where("last").drop("part", "state", "edits", "last"), repaired(turns, seats, segments)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages and repairs all conversations: one row per original conv_id, with the digest of the repaired rows.

    A conversation that the damage took whole has zeros, an empty audit and the
    digest of nothing; an empty table has no rows. Other columns are not read.
    """
    totals, rows = repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    digests = hashed(rows).withColumnRenamed("conv_id", "_of")
    out = ids.join(totals, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("_id").eqNullSafe(F.col("_of")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
