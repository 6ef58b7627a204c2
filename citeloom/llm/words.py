"""Words of whole texts as arrays: shared by the operators that run inside tasks.

A batch of texts is cut into pieces of whole documents; a piece is handled with
array operations over its bytes, so memory is bounded by the piece and not by the
batch (a longer document is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BYTES = 1_000_000
# Separators of words: space and the control characters from tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_ODD = 0x9E3779B97F4A7C15  # base of the polynomial, odd
_INVERSE = pow(_ODD, -1, 1 << 64)


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning; rows without a key may be learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_tables(lower: bool, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it separates words, and what it counts as.

    ``punctuation`` makes all ASCII characters but letters and digits separators.
    """
    separates = np.zeros(256, bool)
    separates[list(SPACES)] = True
    if punctuation:
        separates[:128] |= ~np.array([chr(b).isalnum() for b in range(128)])
    value = np.arange(256, dtype=np.uint8)
    if lower:
        value[ord("A"): ord("Z") + 1] += 32
    return separates, value


@dataclass
class Piece:
    """Consecutive documents of a batch: rows first..first+documents-1 and their bytes."""

    first: int
    offsets: np.ndarray  # documents + 1, from 0
    data: np.ndarray

    @property
    def documents(self) -> int:
        return len(self.offsets) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0]: ends[-1]]


def cut(offsets: np.ndarray, data: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Documents given by offsets in pieces of at most ``limit`` bytes, but of one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1))
        yield Piece(first, offsets[first: last + 1] - offsets[first], data[offsets[first]: offsets[last]])
        first = last


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of a column in pieces of about ``limit`` bytes; null counts as empty."""
    yield from cut(*text_bytes(column), limit)


@dataclass
class Words:
    """Words of a piece: byte ranges, hashes, and the first word of every document."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # documents + 1
    data: np.ndarray  # bytes as they count

    def document(self) -> np.ndarray:
        """The number of its document for every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(piece: Piece, tables: tuple[np.ndarray, np.ndarray]) -> Words:
    """All words of a piece; a word never crosses documents.

    The hash of a word is a polynomial in its bytes, taken from one running sum
    over the piece, then mixed with the length.
    """
    separates, value = tables
    n = len(piece.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(piece.offsets), np.int64), piece.data)
    apart = separates[piece.data]
    data = value[piece.data]
    inside = ~apart
    begins = inside.copy()
    begins[1:] &= apart[:-1]
    heads = piece.offsets[:-1][piece.offsets[:-1] < n]
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= apart[1:]
    tails = piece.offsets[1:][piece.offsets[1:] > 0] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = powers(n + 1)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
    hashes = (running[ends] - running[starts]) * down[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(starts, ends, hashes, np.searchsorted(starts, piece.offsets), data)


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words, over document borders too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed), np.uint64)
    for k in range(width):
        out *= np.uint64(_ODD)
        out += hashes[k: k + n]
    return mix(out)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Words at which a run of ``width`` words of one document starts."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(first[:-1] - before, counts)


def per_document(values: np.ndarray, counts: np.ndarray, op: np.ufunc, empty) -> np.ndarray:
    """``op`` over consecutive groups of ``values`` of the given sizes; ``empty`` for none."""
    out = np.full(len(counts), empty, values.dtype)
    some = counts > 0
    if some.any():
        out[some] = op.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed values that tables hold."""
    return np.ascontiguousarray(x).view(np.int64)
