"""Spelling variants: words of a vocabulary one edit apart, by composing its acceptor with a one-edit transducer.

The composed machine V o E o V starts at the pair of initial states and may read a
common prefix before its one edit. What lies behind a prefix is independent of
what lies behind another, so the vocabulary is dealt by prefixes, each partition the
part of the machine that starts at the state its prefix reaches. Pairs that spend
their edit inside the prefix of a partition leave the edit for equal rests; those
arcs are equi-joins of the words without one letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import written

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
DAMAGED = 97  # one in so many runs of a document loses a letter
GROUP = 5_000  # words a partition of the machine may hold
DEPTH = 2  # code points of the first prefixes; doubled for prefixes of more words

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged_runs(docs: DataFrame) -> DataFrame:
    """(word) of every run of letters in every text: lower case, and some without one letter.

    A run loses the letter its CRC-32 names if that is divisible by 97; the
    checksum is of ``<doc_id>:<run>``, a null id being empty. Null and empty texts
    have no runs.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return low.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words with enough letters and occurrences; counted in the map tasks first."""
    long = words.where(F.length("word") >= least_letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def prefixes(vocab: DataFrame, group: int = GROUP, depth: int = DEPTH) -> DataFrame:
    """Adds ``depth``: the length of the prefix whose state a word's partition starts at.

    Prefixes of more than ``group`` words are doubled in length, round by round; a
    word that ends within its prefix is a partition of its own.
    """
    left, settled = vocab, None
    while True:
        long, prefix = F.length("word") >= depth, F.substring("word", 1, depth)
        hot = written(left.where(long).groupBy(prefix.alias("_prefix")).count().where(F.col("count") > group).select("_prefix"), "hot-prefixes")
        placed = left.withColumn("depth", F.least(F.lit(depth), F.length("word")))
        if hot.isEmpty():
            return placed if settled is None else settled.unionByName(placed)
        # a word that ends before this depth follows no hot prefix of it
        done = placed.join(hot, prefix == hot["_prefix"], "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        left = written(left.join(hot, prefix == hot["_prefix"], "left_semi"), "hot-words")
        depth *= 2


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool], int]:
    """The minimal acyclic acceptor of sorted different words: arcs and finality by state, and the initial state.

    States are kept once per right language: after a word, the states that no later
    word can change are looked up by finality and arcs.
    """
    arcs: list[dict[str, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[tuple[dict[str, int], bool]] = [({}, False)]
    letters: list[str] = []

    def close(length: int) -> None:
        while len(path) > length + 1:
            out, end = path.pop()
            key = (end, tuple(out.items()))
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(out)
                final.append(end)
            path[-1][0][letters.pop()] = state

    for word in words:
        same = 0
        while same < len(letters) and same < len(word) and letters[same] == word[same]:
            same += 1
        close(same)
        for letter in word[same:]:
            letters.append(letter)
            path.append(({}, False))
        path[-1] = (path[-1][0], True)
    close(0)
    arcs.append(path[0][0])
    final.append(path[0][1])
    return arcs, final, len(arcs) - 1


class Composition:
    """One edit between two readings of the acceptor; states behind the edit are pairs, kept only where they accept."""

    def __init__(self, words: list[str]) -> None:
        self.arcs, self.final, self.start = acceptor(words)
        self.behind: dict[tuple[int, int], tuple[bool, list[tuple[str, tuple[int, int]]]] | None] = {}

    def meet(self, a: int, b: int) -> tuple[int, int] | None:
        """The state of both right languages at once, or None where they share no word."""
        first = (a, b) if a <= b else (b, a)
        behind, stack = self.behind, [first]
        while stack:
            state = stack[-1]
            if state in behind:
                stack.pop()
                continue
            p, q = self.arcs[state[0]], self.arcs[state[1]]
            if len(p) > len(q):
                p, q = q, p
            nexts = [(c, (min(s, q[c]), max(s, q[c]))) for c, s in p.items() if c in q]
            open_ = [s for _, s in nexts if s not in behind]
            if open_:
                stack.extend(open_)
                continue
            stack.pop()
            live = [(c, s) for c, s in nexts if behind[s] is not None]
            end = self.final[state[0]] and self.final[state[1]]
            behind[state] = (end, live) if end or live else None
        return first if behind[first] is not None else None

    def _rests(self, state: tuple[int, int], but: str | None = None) -> Iterator[str]:
        """The words accepted behind an edit; ``but`` is a letter they may not start with."""
        stack: list[tuple[tuple[int, int], int, str]] = [(state, 0, "")]
        path: list[str] = []
        while stack:
            state, length, letter = stack.pop()
            del path[max(length - 1, 0):]
            if length:
                path.append(letter)
            end, live = self.behind[state]
            if end:
                yield "".join(path)
            stack.extend((s, length + 1, c) for c, s in live if length or c != but)

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All accepted pairs, once each: (longer, shorter), or by the replaced letter.

        A letter out of a run of equal ones is taken as its last.
        """
        stack: list[tuple[int, int, str]] = [(self.start, 0, "")]
        path: list[str] = []
        while stack:
            state, length, letter = stack.pop()
            del path[max(length - 1, 0):]
            if length:
                path.append(letter)
            out = self.arcs[state]
            edits = []
            for c, s in out.items():
                gone = self.meet(s, state)
                if gone is not None:
                    edits.append((c, "", gone, c))
                edits.extend((c, d, both, None) for d, t in out.items() if c < d and (both := self.meet(s, t)) is not None)
            if edits:
                prefix = "".join(path)
                for c, d, both, but in edits:
                    for rest in self._rests(both, but):
                        yield prefix + c + rest, prefix + d + rest
            stack.extend((s, length + 1, c) for c, s in out.items())


def _within(placed: DataFrame) -> DataFrame:
    """(word, near, near_n) both ways, for pairs whose edit lies behind the prefix of their partition."""
    prefix = F.expr("substring(word, 1, depth)")
    # few bytes, much work: the number of tasks is not left to the size
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (placed.where(F.length("word") > 0).select(prefix.alias("prefix"), "word", "n")
             .repartition(tasks, "prefix").sortWithinPartitions("prefix", "word"))
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, words, rows = None, {}, []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if rows and (last or len(rows) >= 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows.clear()

        def group() -> Iterator[pa.RecordBatch]:
            if len(words) > 1:
                for a, b in Composition([w[len(prefix):] for w in words]).pairs():
                    a, b = prefix + a, prefix + b
                    rows.append((a, b, words[b]))
                    rows.append((b, a, words[a]))
                    yield from flush(False)

        for batch in batches:
            for p, w, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != prefix:
                    yield from group()
                    prefix, words = p, {}
                words[w] = n
        yield from group()
        yield from flush(True)

    return dealt.mapInArrow(enumerate_pairs, "word string, near string, near_n long")


def _ahead(placed: DataFrame) -> DataFrame:
    """(word, near, near_n) both ways, for pairs whose edit lies inside the prefix of a partition.

    The rests behind the edit are equal, so a word meets others by itself without
    one of its first letters: with the same gap for a replacement (at most one word per
    letter of the alphabet shares it), as a whole word for a letter taken out.
    """
    at = F.col("at")
    gaps = placed.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("at"))
    # of equal letters in a row the last is taken out
    last = F.substring("word", at, F.lit(1)) != F.substring("word", at + 1, F.lit(1))
    gaps = gaps.select("word", "n", "at", last.alias("last"), F.concat(F.substring("word", F.lit(1), at - 1), F.substring("word", at + 1, F.length("word"))).alias("rest"))
    a, b = gaps.alias("a"), gaps.alias("b")
    replaced = (a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.word") != F.col("b.word")))
                .select("a.word", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")))
    whole = placed.select(F.col("word").alias("shorter"), F.col("n").alias("shorter_n"))
    taken = gaps.where("last").join(whole, F.col("rest") == F.col("shorter")).select("word", "n", "shorter", "shorter_n")
    ways = F.array(F.struct(F.col("word").alias("word"), F.col("shorter").alias("near"), F.col("shorter_n").alias("near_n")),
                   F.struct(F.col("shorter").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return replaced.unionByName(taken.select(F.inline(ways)))


def near_words(vocab: DataFrame, group: int = GROUP, depth: int = DEPTH) -> DataFrame:
    """(word, near, near_n): every two words of (word, n) that one inserted, deleted or replaced code point sets apart, both ways.

    Words are different and not null. An empty vocabulary has no pairs.
    """
    placed = written(prefixes(written(vocab, "vocabulary"), group, depth), "placed-words")
    return _within(placed).unionByName(_ahead(placed))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: forms followed to the last, by doubling.

    Every form occurs at least twice as often as its word, so there are no rings and
    the rounds are few.
    """
    here = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = here.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        there = written(here.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if there.where("moved").isEmpty():
            return there.select("word", "root")
        here = there.select("word", "root")


def variants(vocab: DataFrame, group: int = GROUP, depth: int = DEPTH) -> DataFrame:
    """Every word of (word, n) with its near words' number, its form and the root of its group.

    A word's form is its most frequent near word (of equal ones the first in
    code-point order) if that occurs at least twice as often; the root is the last of
    the forms, the word itself where it has none.
    """
    vocab = written(vocab, "vocabulary")
    best = F.struct((-F.col("near_n")).alias("order"), "near")
    near = near_words(vocab, group, depth).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    is_form = -F.col("best.order") >= 2 * F.col("n")
    joined = written(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.order")).alias("form_n")), "variants")
    return (joined.join(_roots(joined.where("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Groups the words of whole texts by spelling variants; see ``variants``.

    Null and empty texts and an empty table give no words; repeated rows count
    again; other columns are not read.
    """
    return variants(vocabulary(damaged_runs(docs)))
