"""Scoring texts by prediction by partial matching, beside a unigram base over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.words import Piece, byte_tables, cut, held_out, mix, text_bytes, words
from citeloom.runtime import written

ORDER = 5  # bytes of context
MARK = 0xFF  # no byte of UTF-8: stands before a text, and as one symbol behind it
MODEL_GRAMS = 4_000_000  # of one broadcast model; a larger trie is split and the texts are read once per split
COMMON = 1 << 16  # words of at least 1/COMMON of all tokens: there can be no more than COMMON of them
GROUP_BYTES = 4_000_000
HELD_COUNTS = 800_000  # partial counts of a task before they are summed
SENT_ROWS = 50_000  # of a batch to Spark
PARTS_PER_PARTITION = 4
ROW_BITS = 36  # rows of one input task

_COUNTS = "kind int, key long, n long"
_SENT = "part int, blob binary, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
_SUMMED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
_GRAM, _WORD = 0, 1


def grams(piece: Piece, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol of the texts with ``order`` bytes before it, packed; and how many each text has.

    A text is lower-cased (A-Z), follows ``order`` marks, and ends with a mark.
    """
    n, docs = len(piece.data), piece.documents
    lengths = np.diff(piece.offsets)
    whole = np.full(n + docs * (order + 1), MARK, np.uint8)
    text_of = np.repeat(np.arange(docs), lengths)
    whole[np.arange(n) + text_of * (order + 1) + order] = byte_tables(lower=True)[1][piece.data]
    packed = np.zeros(len(whole), np.uint64)
    for k in range(order + 1):
        packed[k:] |= whole[: len(whole) - k].astype(np.uint64) << np.uint64(8 * k)
    symbol = np.ones(len(whole), bool)
    heads = piece.offsets[:-1] + np.arange(docs) * (order + 1)
    for k in range(order):
        symbol[heads + k] = False
    return packed[symbol], lengths + 1


def _reduced(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {_GRAM: [], _WORD: []}
            for piece in cut(*text_bytes(batch.column(0))):
                found[_GRAM].append(np.unique(grams(piece, order)[0], return_counts=True))
                found[_WORD].append(np.unique(words(piece, byte_tables(lower=True)).hashes, return_counts=True))
                for kind, parts in found.items():
                    if sum(len(k) for k, _ in parts) > HELD_COUNTS:
                        found[kind] = [_reduced(parts)]
            for kind, parts in found.items():
                if parts:
                    keys, n = _reduced(parts)
                    parts.clear()
                    for k in range(0, len(keys), SENT_ROWS):
                        some = keys[k: k + SENT_ROWS].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[k: k + SENT_ROWS])],
                                                         names=["kind", "key", "n"])

    return count


class Slots:
    """Places of 64-bit keys, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray, table: np.ndarray | None = None):
        self.keys = keys
        if table is not None:
            self.table, self.bits = table, len(table).bit_length() - 1
            return
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key, -1 if it is none."""
        slot = self._slot(keys)
        out = self.table[slot]
        if len(self.keys) == 0:
            return out
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.table) - 1)
            out[wrong] = self.table[slot[wrong]]
            at = out[wrong]
            wrong = wrong[(at >= 0) & (self.keys[at] != keys[wrong])]
        return out


@dataclass
class Level:
    """One depth of the trie: grams of a context and a symbol, and the contexts."""

    grams: Slots
    count: np.ndarray
    contexts: Slots
    total: np.ndarray  # occurrences of the context
    distinct: np.ndarray  # symbols seen after it
    covered: np.ndarray  # occurrences that these symbols have one level up


class Model:
    """Context trie of orders 0..order with escape estimation (method C) and symbol exclusion."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, symbols: np.ndarray):
        """``keys``: packed grams of the highest order; ``symbols``: counts of all 256 symbols at order 0."""
        self.order = order
        self.levels: list[Level] = []
        level_keys, level_counts = keys, counts
        stack = []
        for j in range(order, 0, -1):
            stack.append((level_keys, level_counts))
            level_keys, level_counts = _reduced([(level_keys & np.uint64((1 << 8 * j) - 1), level_counts)])
        zero = np.flatnonzero(symbols)
        stack.append((zero.astype(np.uint64), symbols[zero].astype(np.int64)))
        for j, (k, n) in enumerate(reversed(stack)):
            contexts, first = np.unique(k >> np.uint64(8), return_index=True)
            sizes = np.diff(np.append(first, len(k)))
            total = np.add.reduceat(n, first) if len(k) else np.zeros(0, np.int64)
            covered = np.zeros(len(contexts), np.int64)
            if j and len(k):
                lower = self.levels[-1]
                covered = np.add.reduceat(lower.count[lower.grams.find(k & np.uint64((1 << 8 * j) - 1))], first)
            self.levels.append(Level(Slots(k), n.astype(np.int32) if n.max(initial=0) < 1 << 31 else n, Slots(contexts), total, sizes.astype(np.int16), covered))
        self._ready()

    def _ready(self) -> None:
        top = self.levels[-1]
        at = top.contexts.find(top.grams.keys >> np.uint64(8))
        self.direct = np.log10(top.count / (top.total[at] + top.distinct[at])) if len(at) else np.zeros(0)

    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        """Plain arrays of all levels, for a broadcast."""
        return [(x.grams.keys, x.grams.table, x.count, x.contexts.keys, x.contexts.table, x.total, x.distinct, x.covered) for x in self.levels]

    @classmethod
    def of_arrays(cls, arrays: list[tuple[np.ndarray, ...]]) -> Model:
        out = cls.__new__(cls)
        out.order = len(arrays) - 1
        out.levels = [Level(Slots(a, b), c, Slots(d, e), f, g, h) for a, b, c, d, e, f, g, h in arrays]
        out._ready()
        return out

    def scores(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol after its context."""
        found = self.levels[-1].grams.find(packed)
        out = self.direct[found] if len(self.direct) else np.zeros(len(packed))
        rest = np.flatnonzero(found < 0)
        if len(rest):
            out[rest] = self._backed_off(packed[rest])
        return out

    def _backed_off(self, packed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(packed))
        open_ = np.ones(len(packed), bool)
        above_distinct = np.zeros(len(packed), np.int64)  # of the context one level down, 0 if none was seen
        above_covered = np.zeros(len(packed), np.int64)
        for j in range(self.order, -1, -1):
            level = self.levels[j]
            at = np.flatnonzero(open_)
            if len(at) == 0:
                return out
            key = packed[at] & np.uint64((1 << 8 * (j + 1)) - 1)
            context = level.contexts.find(key >> np.uint64(8))
            seen = context >= 0
            at, key, context = at[seen], key[seen], context[seen]
            fresh = level.distinct[context] - above_distinct[at]
            mass = level.total[context] - above_covered[at] + fresh
            gram = level.grams.find(key)
            hit = gram >= 0
            out[at[hit]] += np.log10(level.count[gram[hit]] / mass[hit])
            open_[at[hit]] = False
            miss = ~hit & (fresh > 0)
            out[at[miss]] += np.log10(fresh[miss] / mass[miss])
            above_distinct[at] = level.distinct[context]
            above_covered[at] = level.covered[context]
        at = np.flatnonzero(open_)
        known = int(self.levels[0].distinct.sum())
        out[at] -= np.log10(256 - known)
        return out


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


def _pack(base: int, tokens: np.ndarray, trained: np.ndarray, sizes: np.ndarray, rows: np.ndarray, times: np.ndarray) -> bytes:
    head = np.array([base, len(tokens), len(rows)], np.int64)
    raw = b"".join(x.tobytes() for x in (head, tokens, trained.astype(np.int64), sizes.astype(np.int32), rows.astype(np.int32), times.astype(np.int32)))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    base, tokens, rows = np.frombuffer(raw, np.int64, 3).tolist()
    at, out = 24, []
    for kind, n in ((np.uint64, tokens), (np.int64, tokens), (np.int32, tokens), (np.int32, rows), (np.int32, rows)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out[0], out[1], out[2], out[3].astype(np.int64) + base, out[4]


def _postings(base: int, token: np.ndarray, row: np.ndarray, train: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Words of a group of texts by part of their hash: which rows hold them, how often, how often in training."""
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(token)))
    token, row = token[head], row[head]
    part = (mix(token) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    token, row, times, part = token[order], row[order], times[order], part[order]
    for g in np.split(np.arange(len(token)), np.flatnonzero(np.diff(part)) + 1):
        if len(g):
            t, first = np.unique(token[g], return_index=True)
            yield int(part[g[0]]), _pack(base, t, np.add.reduceat(np.where(train[row[g]], times[g], 0), first), np.diff(np.append(first, len(g))), row[g], times[g])


def _scorer(model, common, parts: int, order: int, split: tuple[int, int]):
    """Scores symbols whose last context byte lies in ``split``; the first split also handles words."""
    lo, hi = split

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Model.of_arrays(model.value)
        keys, logs = common.value
        slots = Slots(keys)
        base = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            ids, held = batch.column(0), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for group in cut(*text_bytes(batch.column(2)), GROUP_BYTES):
                n = group.documents
                mine = slice(group.first, group.first + n)
                code, tokens, known, base_sum = np.zeros(n), np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                rare_token, rare_row = [], []
                for piece in cut(group.offsets, group.data):
                    at = slice(piece.first, piece.first + piece.documents)
                    packed, counts = grams(piece, order)
                    if (lo, hi) == (0, 256):
                        values = trie.scores(packed)
                    else:
                        last = (packed >> np.uint64(8)) & np.uint64(0xFF)
                        ours = np.flatnonzero((last >= lo) & (last < hi))
                        values = np.zeros(len(packed))
                        values[ours] = trie.scores(packed[ours])
                    code[at] = _per_text(values, counts)
                    if lo:
                        continue
                    found = words(piece, byte_tables(lower=True))
                    document = found.document()
                    tokens[at] += np.diff(found.first)
                    place = slots.find(found.hashes)
                    hit = place >= 0
                    known[at] = np.bincount(document[hit], minlength=piece.documents)
                    base_sum[at] = np.bincount(document[hit], logs[place[hit]] if hit.any() else None, piece.documents)
                    rare_token.append(found.hashes[~hit])
                    rare_row.append(document[~hit] + piece.first)
                row = base + np.arange(n)
                first = not lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array((row % parts).astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(row), ids[mine] if first else pa.nulls(n, pa.int64()),
                     pa.array(held[mine]) if first else pa.nulls(n, pa.bool_()), pa.array(tokens if first else np.zeros(n, np.int64)),
                     pa.array(known), pa.array(base_sum), pa.array(code)],
                    names=["part", "blob", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score"])
                if first and sum(map(len, rare_token)):
                    blobs = list(_postings(base, np.concatenate(rare_token), np.concatenate(rare_row), ~held[mine], parts))
                    m = len(blobs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p for p, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())]
                        + [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                        names=["part", "blob", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score"])
                base += n

    return score


def _word_sums(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one part: rows, their known words, and the sum of log10(c + 1) over their words."""
    parts = [_unpack(b) for b in blobs]
    token, trained, sizes, row, times = (np.concatenate([p[k] for p in parts]) for k in range(5))
    keys, inverse = np.unique(token, return_inverse=True)
    c = np.bincount(inverse, trained, len(keys))
    value = np.repeat(c[inverse], sizes)
    rows, at = np.unique(row, return_inverse=True)
    return rows, np.bincount(at, np.where(value > 0, times, 0), len(rows)).astype(np.int64), np.bincount(at, times * np.log10(value + 1), len(rows))


_NAMES = ["part", "blob", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score"]


def _added(sums: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, at = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
    known = np.bincount(at, np.concatenate([s[1] for s in sums]), len(rows)).astype(np.int64)
    return rows, known, np.bincount(at, np.concatenate([s[2] for s in sums]), len(rows))


def _gatherer(parts: int):
    """Handles one part of the words after the other; the sums of a task go packed to the parts of their rows."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, sums = None, [], []
        for batch in batches:
            plain = batch.filter(batch.column(1).is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays(plain.columns, names=_NAMES)
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if held:
                        sums.append(_word_sums(held))
                    part, held = p, []
                if blob.is_valid:
                    held.append(blob.as_py())
        if held:
            sums.append(_word_sums(held))
        if not sums:
            return
        rows, known, base = _added(sums)
        to = (rows % parts).astype(np.int32)
        order = np.argsort(to, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
        blobs = [pa.compress(rows[g].tobytes() + known[g].tobytes() + base[g].tobytes(), codec="zstd", asbytes=True) for g in groups]
        yield pa.RecordBatch.from_arrays(
            [pa.array(to[[g[0] for g in groups]]), pa.array(blobs, pa.binary()), pa.array([len(g) for g in groups], pa.int64())]
            + [pa.nulls(len(groups), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=_NAMES)

    return gather


def _finished(plain: list[pa.RecordBatch], blobs: list[tuple[bytes, int]]) -> pa.RecordBatch:
    """The rows of one part with all their sums: several rows of a document come from several splits of the trie."""
    table = pa.Table.from_batches(plain)
    row = table["row"].to_numpy()
    rows, at = np.unique(row, return_inverse=True)

    def total(name: str) -> np.ndarray:
        return np.bincount(at, table[name].to_numpy(), len(rows))

    tokens, known, base, score = (total(c) for c in ("n_tokens", "known", "base", "score"))
    named = np.flatnonzero(table["held_out"].is_valid().to_numpy())  # one of a document's rows
    named = named[np.argsort(row[named], kind="stable")]
    for blob, n in blobs:
        raw = pa.decompress(blob, 24 * n, codec="zstd", asbytes=True)
        place = np.searchsorted(rows, np.frombuffer(raw, np.int64, n))
        known[place] += np.frombuffer(raw, np.int64, n, 8 * n)
        base[place] += np.frombuffer(raw, np.float64, n, 16 * n)
    take = pa.array(named)
    return pa.RecordBatch.from_arrays(
        [table["doc_id"].combine_chunks().take(take), table["held_out"].combine_chunks().take(take), pa.array(tokens.astype(np.int64)),
         pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "known", "base", "score"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of the rows after the other."""
    part, plain, blobs = None, [], []
    for batch in batches:
        column = batch.column(0).to_numpy()
        for g in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(column)) + 1):
            if len(g) == 0:
                continue
            if int(column[g[0]]) != part:
                if plain:
                    yield _finished(plain, blobs)
                part, plain, blobs = int(column[g[0]]), [], []
            some = batch.slice(int(g[0]), len(g))
            packed = some.filter(some.column(1).is_valid())
            blobs += list(zip(packed.column(1).to_pylist(), packed.column(2).to_pylist(), strict=True))
            plain.append(some.filter(some.column(1).is_null()))
    if plain:
        yield _finished(plain, blobs)


def _splits(per_byte: dict[int, int], limit: int) -> list[tuple[int, int]]:
    """Ranges of the last context byte with at most ``limit`` grams each, or of one byte."""
    out, lo, held = [], 0, 0
    for b in range(256):
        n = per_byte.get(b, 0)
        if held and held + n > limit:
            out.append((lo, b))
            lo, held = b, 0
        held += n
    return [*out, (lo, 256)]


def score_documents(docs: DataFrame, order: int = ORDER, modulus: int = 7, remainder: int = 2, model_grams: int = MODEL_GRAMS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all documents whose crc32(doc_id as text) mod ``modulus`` is not
    ``remainder`` (rows without id too). ``score`` is the log10 probability of the
    lower-cased (A-Z) UTF-8 bytes and an end mark under the context trie. Null and
    empty texts are an end alone. Without training rows every symbol has
    probability 1/256 and every token log10(1).

    Counts of byte grams and words are partial sums per batch and one aggregation.
    The trie is broadcast in splits of at most ``model_grams`` grams by the last
    context byte (order 0 is in all; one byte's grams stay together); more than
    one split costs another reading each, and adds up to the same score. Words of at
    least one 65536th of all tokens, of which there are at most 65536, are broadcast
    with their counts; all other words travel to the part of their hash, where
    their counts are summed and go back to the part of their document, packed. Words
    are told apart by 64-bit hashes.
    """
    held = held_out(F.col("doc_id"), modulus, remainder)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    counts = written(table.where(~F.col("held_out")).select("text").mapInArrow(_counter(order), _COUNTS)
                     .groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    ends = table.where(~F.col("held_out")).count()
    found = counts.where(F.col("kind") == _WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = found["n"] + ends, found["v"] + bool(ends)
    common = counts.where((F.col("kind") == _WORD) & (F.col("n") * COMMON >= max(tokens, 1))).select("key", "n").toArrow()
    keys = common["key"].to_numpy().view(np.uint64)
    spark = docs.sparkSession
    words_sent = spark.sparkContext.broadcast((keys, np.log10(common["n"].to_numpy() + 1.0)))
    trie = counts.where(F.col("kind") == _GRAM)
    symbols = np.zeros(256, np.int64)
    for r in trie.groupBy(F.col("key").bitwiseAND(F.lit(255)).alias("s")).agg(F.sum("n").alias("n")).collect():
        symbols[r["s"]] = r["n"]
    last = F.shiftright("key", 8).bitwiseAND(F.lit(255))
    per_byte = {r["b"]: r["n"] for r in trie.groupBy(last.alias("b")).agg(F.count("*").alias("n")).collect()}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, sent = PARTS_PER_PARTITION * partitions, None
    splits = _splits(per_byte, model_grams)
    if len(splits) > 1:  # rows are numbered by their place in the input, so all readings must be of one stored table
        table = written(table, "texts")
    for lo, hi in splits:
        got = trie.where((last >= lo) & (last < hi)).select("key", "n").orderBy("key").toArrow()
        model = spark.sparkContext.broadcast(Model(got["key"].to_numpy().view(np.uint64), got["n"].to_numpy(), order, symbols).arrays())
        one = table.mapInArrow(_scorer(model, words_sent, parts, order, (lo, hi)), _SENT)
        one = written(one, "split-scores") if len(splits) > 1 else one
        sent = one if sent is None else sent.unionByName(one)
    sums = sent.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_gatherer(parts), _SENT)
    whole = sums.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_finish, _SUMMED)
    end = float(np.log10(ends + 1))
    share = float(np.log10(tokens + distinct + 1))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("known") + int(bool(ends))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                        (F.col("base") + end - F.col("n_tokens") * share).alias("base_score"), "score")
