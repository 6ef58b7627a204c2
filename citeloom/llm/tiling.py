"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.bloom import bloom, may_hold
from citeloom.llm.words import byte_tables, pieces, window_hashes, window_starts, words
from citeloom.runtime import written

SHORTEST = 4  # words of a tile
COVERAGE = 50  # percent of a test's words that tiles must cover
ROW_BITS = 36  # rows of one input task

_HITS = "row long, doc_id long, n_words long, seed long, pos array<int>"
_TILED = "row long, item_id long, covered int, tiles int"


def tokens():
    """Words for matching: ASCII letters in lower case, digits and other characters; punctuation separates."""
    return byte_tables(lower=True, punctuation=True)


def _seeder(shortest: int, held: np.ndarray | None):
    """Rows for the texts (seed null), and one for each different window of a text that the filter lets through, with its positions."""
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if batch.column(0).null_count == 0 else None
            for piece in pieces(batch.column(1)):
                found = words(piece, tokens())
                at = window_starts(found.first, shortest)
                seed = window_hashes(found.hashes, shortest)[at] if len(at) else np.zeros(0, np.uint64)
                if held is not None:
                    passed = may_hold(held, seed)
                    at, seed = at[passed], seed[passed]
                doc = np.searchsorted(found.first, at, "right") - 1
                order = np.lexsort((at, seed, doc))
                at, seed, doc = at[order], seed[order], doc[order]
                heads = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])][:len(at)])
                n = piece.documents
                text = np.concatenate([np.arange(n), doc[heads]])
                owner = pa.array(ids[piece.first + text]) if ids is not None else batch.column(0).take(pa.array(piece.first + text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + piece.first + text), owner, pa.array(np.diff(found.first)[text]),
                     pa.array(np.concatenate([np.zeros(n, np.int64), seed[heads].view(np.int64)]), mask=np.arange(len(text)) < n),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n, np.int32), heads, [len(at)]]).astype(np.int32)), pa.array((at - found.first[doc]).astype(np.int32)))],
                    names=["row", "doc_id", "n_words", "seed", "pos"])
            row += batch.num_rows

    return seeds


def matches(hits: list[tuple[np.ndarray, np.ndarray]], shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of windows that match, as (text positions, test positions, words), from each window's positions in both.

    Follows the diagonals from one test position to the next, so that only the text
    positions of one window are open at a time, however often both repeat it.
    """
    by_test: dict[int, list[np.ndarray]] = {}
    for positions, tests in hits:
        for q in tests.tolist():
            by_test.setdefault(q, []).append(positions)
    none = np.zeros(0, np.int64)
    before, count, last = none, none, -1
    runs = []

    def end(positions: np.ndarray, counts: np.ndarray, q: int) -> None:
        if len(positions):
            runs.append((positions - counts + 1, q - counts + 1, counts + shortest - 1))

    for q in sorted(by_test):
        here = by_test[q][0].astype(np.int64) if len(by_test[q]) == 1 else np.unique(np.concatenate(by_test[q])).astype(np.int64)
        if q != last + 1:
            end(before, count, last)
            before, count = none, none
        at = np.searchsorted(before, here - 1)
        goes_on = np.zeros(len(here), bool)
        inside = at < len(before)
        goes_on[inside] = before[at[inside]] == here[inside] - 1
        length = np.ones(len(here), np.int64)
        length[goes_on] += count[at[goes_on]]
        over = np.ones(len(before), bool)
        over[at[goes_on]] = False
        end(before[over], count[over], last)
        before, count, last = here, length, q
    end(before, count, last)
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (none, none, none)


def _free_runs(marked: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches without mark of ``shortest`` or more."""
    edges = np.flatnonzero(np.diff(np.r_[True, marked, True].astype(np.int8)))
    return [(a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= shortest]


def tile_hits(hits: list[tuple[np.ndarray, np.ndarray]], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, test position, words) from each shared window's positions, ascending, in text and test.

    The longest match whose words are all free is marked; a match that marked words
    interrupt goes back as its free parts. Ties go to the earlier text, then test
    position. It ends early when the test has no free words left for a tile.
    """
    texts, tests, lengths = matches(hits, shortest)
    if not len(texts):
        return []
    order = np.lexsort((tests, texts, -lengths))
    text_marked = np.zeros(int((texts + lengths).max()), bool)
    test_marked = np.zeros(int((tests + lengths).max()), bool)
    parts: list[tuple[int, int, int]] = []
    tiles = []
    at = 0
    while at < len(order) or parts:
        k = order[at] if at < len(order) else None
        whole = None if k is None else (-int(lengths[k]), int(texts[k]), int(tests[k]))
        if whole is None or parts and parts[0] < whole:
            n, p, q = heapq.heappop(parts)
        else:
            n, p, q = whole
            at += 1
        n = -n
        marked = text_marked[p: p + n] | test_marked[q: q + n]
        if not marked.any():
            tiles.append((p, q, n))
            text_marked[p: p + n] = True
            test_marked[q: q + n] = True
            if not _free_runs(test_marked, shortest):
                break
            continue
        for start, size in _free_runs(marked, shortest):
            heapq.heappush(parts, (-size, p + start, q + start))
    return tiles


def tile(pairs: list[tuple[int, int]], shortest: int) -> list[tuple[int, int, int]]:
    """``tile_hits`` of windows that match at (text, test) positions."""
    return tile_hits([(np.array([p]), np.array([q])) for p, q in pairs], shortest)


def _tiler(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, count = [], []
            for k in range(batch.num_rows):
                windows = batch.column(2)[k].values
                sides = [(windows.field(side).offsets.to_numpy(), windows.field(side).values.to_numpy()) for side in ("pos", "at")]
                found = tile_hits([tuple(values[ends[n]: ends[n + 1]] for ends, values in sides) for n in range(len(windows))], shortest)
                covered.append(sum(n for _, _, n in found))
                count.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covered, pa.int32()), pa.array(count, pa.int32())],
                                             names=["row", "item_id", "covered", "tiles"])

    return run


def coverages(docs: DataFrame, tests: DataFrame, shortest: int = SHORTEST) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs`` (row, doc_id, n_words), and (row, item_id, n_test, covered, tiles) of those that share a window with a test.

    Windows of ``shortest`` words are hashed by a running polynomial. A filter of
    fixed size built from the tests skips windows that no test has; the rest is
    joined with the tests' windows, so any number of tests is handled and a passage
    that many documents share is split like any skewed join key. A window travels
    with its positions, so what a text and a test both repeat is never multiplied out.
    """
    named = tests.select(F.col("item_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    made = written(named.mapInArrow(_seeder(shortest, None), _HITS), "tests")
    positions = F.sort_array(F.array_distinct(F.flatten(F.collect_list("pos"))))
    windows = written(made.where("seed IS NOT NULL").groupBy("seed", F.col("doc_id").alias("item_id")).agg(positions.alias("at")), "test-windows")
    sizes = made.where("seed IS NULL").groupBy(F.col("doc_id").alias("item_id")).agg(F.max("n_words").alias("n_test"))
    found = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_seeder(shortest, bloom(windows, "seed")), _HITS), "text-windows")
    shared = (found.where("seed IS NOT NULL").select("row", "seed", "pos").join(windows, "seed").groupBy("row", "item_id")
              .agg(F.collect_list(F.struct("pos", "at")).alias("windows")))
    tiled = shared.select("row", "item_id", "windows").mapInArrow(_tiler(shortest), _TILED).join(sizes, "item_id")
    return found.where("seed IS NULL").select("row", "doc_id", "n_words"), tiled


def contamination(docs: DataFrame, tests: DataFrame, shortest: int = SHORTEST, coverage: int = COVERAGE) -> DataFrame:
    """One row per document: doc_id, n_words, contaminated, n_items, item_id, coverage.

    ``contaminated``: tiles cover at least ``coverage`` percent of some test's words,
    in whatever order. ``n_items`` counts such tests; ``item_id`` and ``coverage`` tell
    the best covered one (ties to the smaller id), null if none reaches the
    threshold. Null and empty texts hold nothing; tests shorter than ``shortest``
    words, without text or without id are not searched for. Rows of one item_id are
    one test, as long as the longest of them.
    """
    rows, tiled = coverages(docs, tests, shortest)
    best = (tiled.where(100 * F.col("covered") >= coverage * F.col("n_test"))
            .select("row", "item_id", F.round(F.least(F.lit(1.0), F.col("covered") / F.col("n_test")), 6).alias("coverage"))
            .groupBy("row").agg(F.count("*").alias("n_items"), F.min(F.struct(-F.col("coverage"), "item_id")).alias("best")))
    return (rows.join(best, "row", "left")
            .select("doc_id", "n_words", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.col("best.item_id").alias("item_id"), (-F.col("best.col1")).alias("coverage")))


def keep_clean(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents that hold no test; columns stay as they are. An id goes if all its rows do."""
    gone = (contamination(docs, tests, **options).groupBy(F.col("doc_id").alias("_gone")).agg(F.min("contaminated").alias("_all"))
            .where("_all").select("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
