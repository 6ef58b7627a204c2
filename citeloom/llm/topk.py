"""Exact top-k inner products over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import written

BLOCK_ROWS = 8192
QUERY_ROWS = 256
UNITS_PER_TASK = 128

_BLOCKS = "dim int, ids binary, low binary, depth binary, slices binary"
_TILES = "dim int, query_ids binary, query binary"
_FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); vectors with a null or non-finite part are left out."""
    v = F.col(vector)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (vectors.where(F.col(key).isNotNull() & F.coalesce(whole, F.lit(False)))
            .select(F.col(key).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def _matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) with at most ``rows`` rows each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def joined(dim: int) -> tuple[int, np.ndarray, np.ndarray]:
        got = held.pop(dim)
        return dim, np.concatenate([i for i, _ in got]), np.concatenate([m for _, m in got])

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        lengths = np.asarray(lists.value_lengths().to_numpy())
        flat = lists.flatten().to_numpy()
        begins = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            for k in range(0, len(at), rows):
                some = at[k: k + rows]
                held.setdefault(dim, []).append((ids[some], flat[begins[some][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= rows:
                    _, i, m = joined(dim)
                    yield dim, i[:rows], m[:rows]
                    if len(i) > rows:
                        held[dim] = [(i[rows:], m[rows:])]
    for dim in sorted(held):
        yield joined(dim)


def sliced(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit slices of a block: lowest value and number of slices per attribute, and all slices.

    Attribute by attribute, lowest slice first; a slice holds one bit per row,
    64 rows to a word. Values are taken above the attribute's lowest value.
    """
    n, dim = matrix.shape
    low = matrix.min(axis=0) if n else np.zeros(dim, np.int64)
    high = matrix.max(axis=0) - low if n else low
    depth = np.array([int(h).bit_length() for h in high], np.int64)
    width = -(-n // 64) * 64
    out = []
    for j in range(dim):
        column = np.zeros(width, np.uint64)
        column[:n] = (matrix[:, j] - low[j]).astype(np.uint64)
        for b in range(int(depth[j])):
            out.append(np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64))
    return low, depth, np.array(out, np.uint64).reshape(len(out), width // 64)


def index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index: one row per block of up to ``block_rows`` vectors of one dimension.

    Blocks follow a round-robin deal, so no key can make one large.
    """
    blocks = -(-vectors.count() // block_rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32())] + [(c, pa.binary()) for c in ("ids", "low", "depth", "slices")])
        for dim, ids, matrix in _matrices(batches, block_rows):
            low, depth, slices = sliced(matrix)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, low, depth, slices)], schema=schema)

    return vectors.repartition(max(1, blocks)).mapInArrow(build, _BLOCKS)


def add_slices(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Sums bitmaps row by row: ``columns[w]`` holds groups of slices of weight 2**w.

    Three slices of a weight become one of that weight and one of the next (a
    full adder on whole bitmaps) until one slice per weight is left.
    """
    out, w = [], 0
    while columns and (w <= max(columns)):
        stack = np.concatenate(columns.pop(w)) if columns.get(w) else np.zeros((0, words), np.uint64)
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third: 2 * third], stack[2 * third: 3 * third]
                either = a ^ b
                carry = (a & b) | (c & either)
                stack = np.concatenate([stack[3 * third:], either ^ c])
            else:
                carry = (stack[0] & stack[1])[None]
                stack = (stack[0] ^ stack[1])[None]
            columns.setdefault(w + 1, []).append(carry)
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        w += 1
    return out


def _count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def best_rows(slices: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k highest, and of those that tie for the rest.

    From the most significant slice down: if the rows seen as high by this slice
    are too many, the others go; if they suffice, they are in.
    """
    sure, open_ = np.zeros_like(valid), valid
    for s in reversed(slices):
        taken = sure | (open_ & s)
        n = _count(taken)
        if n > k:
            open_ = open_ & s
        else:
            sure, open_ = taken, open_ & ~s
            if n == k:
                return sure, np.zeros_like(valid)
    return sure, open_


def _rows(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


class Block:
    """One block of the index, as read back."""

    def __init__(self, dim: int, ids: bytes, low: bytes, depth: bytes, slices: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.low, self.depth = np.frombuffer(low, np.int64), np.frombuffer(depth, np.int64)
        self.words = -(-len(self.ids) // 64)
        self.slices = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        self.first = np.cumsum(self.depth) - self.depth
        self.valid = np.packbits(np.arange(self.words * 64) < len(self.ids), bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices of all rows, and what to add to them.

        A negative factor adds the complement, which turns it into a positive one
        up to a constant.
        """
        groups: dict[int, list[int]] = {}
        flipped: dict[int, list[int]] = {}
        constant = 0
        for j, q in enumerate(query.tolist()):
            depth, at = int(self.depth[j]), int(self.first[j])
            constant += q * int(self.low[j])
            if q < 0:
                constant += q * ((1 << depth) - 1)
            into, size = (groups, q) if q > 0 else (flipped, -q)
            for a in range(size.bit_length()):
                if size >> a & 1:
                    for b in range(depth):
                        into.setdefault(a + b, []).append(at + b)
        columns: dict[int, list[np.ndarray]] = {}
        for w, at in groups.items():
            columns.setdefault(w, []).append(self.slices[at])
        for w, at in flipped.items():
            columns.setdefault(w, []).append(~self.slices[at])
        return add_slices(columns, self.words), constant

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's k best rows for a query, ties to the smaller id."""
        slices, constant = self.scores(query)
        own = np.flatnonzero(self.ids == query_id)
        valid = self.valid
        if len(own):
            valid = valid.copy()
            np.bitwise_and.at(valid, own >> 6, ~(np.uint64(1) << (own & 63).astype(np.uint64)))
        sure, tied = best_rows(slices, valid, k)
        rows = _rows(sure)
        if len(rows) < k:
            rest = _rows(tied)
            rows = np.concatenate([rows, rest[np.argsort(self.ids[rest], kind="stable")[: k - len(rows)]]])
        score = np.full(len(rows), constant, np.int64)
        for w, s in enumerate(slices):
            score += (((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)) << w
        return self.ids[rows], score


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    ``vectors`` and ``queries`` are as ``quantised`` returns them. A query meets
    every row but those of its own id; rows and queries of different dimension do
    not meet. Every (index block, query tile) pair is one unit of work; a block
    returns k rows per query, so neither the driver nor a task holds all scores.
    Queries are told apart by id: of repeated ids the smallest vector asks.
    Scores must fit 63 bits.
    """
    blocks = written(index(vectors, block_rows), "slices").withColumn("block", F.monotonically_increasing_id())
    blocks = written(blocks, "slices-numbered")
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("query_ids", pa.binary()), ("query", pa.binary())])
        for dim, ids, matrix in _matrices(batches, query_rows):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                                              pa.array([matrix.astype(np.int64).tobytes()], pa.binary())], schema=schema)

    many = max(1, -(-asked.count() // query_rows))
    tiled = written(asked.repartition(many).mapInArrow(tiles, _TILES), "query-tiles")
    # The grid: every tile goes to every block of its dimension, by an equi-join on the block.
    grid = tiled.join(blocks.select("dim", "block"), "dim")
    # A batch inside a task then holds few units, whatever their number.
    deal = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grid.count() // UNITS_PER_TASK))
    units = (grid.join(blocks.drop("dim"), "block")
             .select("dim", "query_ids", "query", "ids", "low", "depth", "slices").repartition(deal))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, query, *parts = (c[i].as_py() for c in batch.columns)
                block = Block(dim, *parts)
                ids = np.frombuffer(ids, np.int64)
                query = np.frombuffer(query, np.int64).reshape(len(ids), dim)
                found = [block.top(q, row, k) for q, row in zip(ids.tolist(), query, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, [len(v) for v, _ in found])), pa.array(np.concatenate([v for v, _ in found])),
                     pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (units.mapInArrow(match, _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def divisible(vectors: DataFrame, step: int = 50) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``step``."""
    return vectors.where(F.col("vec_id") % step == 0)
