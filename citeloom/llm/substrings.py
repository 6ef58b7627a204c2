"""Exact removal of word windows that an earlier document holds, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.bloom import bloom, may_hold
from citeloom.llm.words import Piece, byte_tables, cut, text_bytes, window_hashes, window_starts, words
from citeloom.runtime import written

WIDTH = 13  # words of a window
MINIMISER = 3  # words of a minimiser
GROUP_BYTES = 16_000_000  # texts that are combined before the shuffle
PARTS_PER_PARTITION = 4
NO_ID = np.iinfo(np.int64).max  # a row without id counts as later than all others

_SENT = "part int, blob binary, doc_id long, text_hash long, span_start int, span_words int"
_MARKS = "doc_id long, text_hash long, span_start int, span_words int"


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def super_kmers(piece: Piece, width: int, minimiser: int) -> tuple[bytes, np.ndarray, ...]:
    """Runs of consecutive windows that share a minimiser, of the texts of a piece.

    Returns the texts with words one space apart, and for every run: its minimiser,
    document, first word in it, number of windows, and byte range.
    """
    found = words(piece, byte_tables(lower=False))
    begin = window_starts(found.first, width)
    lengths = found.ends - found.starts
    spaced = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    inside = ~byte_tables(lower=False)[0][piece.data]
    spaced[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = piece.data[inside]
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    if len(begin) == 0:
        none = np.zeros(0, np.int64)
        return spaced.tobytes(), none.view(np.uint64), none, none, none, none, none
    low = _lowest(window_hashes(found.hashes, minimiser), width - minimiser + 1)[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1] + 1) | (low[1:] != low[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(begin)))
    word = begin[head]
    document = np.searchsorted(found.first, word, "right") - 1
    return (spaced.tobytes(), low[head], document, word - found.first[document], count,
            at[word], at[word + count + width - 1] - 1)


def pack(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> bytes:
    base = int(ids.min())
    whole = [np.array([len(ids), base], np.int64), ids - base, hashes.astype(np.uint32), starts.astype(np.int32),
             np.array([len(t) for t in texts], np.int32)]
    raw = b"".join([x.tobytes() for x in whole] + texts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, base = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16
    out = []
    for kind in (np.int64, np.uint32, np.int32, np.int32):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out[0] + base, out[1].astype(np.int64), out[2], out[3].astype(np.int64), np.frombuffer(raw, np.uint8, offset=at)


def _spans(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch | None:
    """Mark rows; runs that follow each other in a document become one."""
    if len(ids) == 0:
        return None
    order = np.lexsort((starts, hashes, ids))
    ids, hashes, starts, counts = ids[order], hashes[order], starts[order], counts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (starts[1:] != starts[:-1] + counts[:-1])
    head = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[head]), pa.array(hashes[head]), pa.array(starts[head].astype(np.int32)),
         pa.array(np.add.reduceat(counts, head).astype(np.int32))], names=["doc_id", "text_hash", "span_start", "span_words"])


def _as_sent(marks: pa.RecordBatch, parts: int) -> pa.RecordBatch:
    n = marks.num_rows
    part = (marks.column(0).to_numpy() % parts).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(n, pa.binary()), *marks.columns],
                                      names=["part", "blob", "doc_id", "text_hash", "span_start", "span_words"])


def sender(parts: int, width: int, minimiser: int):
    """Cuts texts into super-k-mers and packs them by part of their minimiser.

    Of equal super-k-mers in a group of texts only those of the earliest document
    travel; the windows of the others are known to be repeats and become marks at
    once. So a passage of very many documents sends one string per group.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            hashes = batch.column(1).to_numpy()
            for group in cut(*text_bytes(batch.column(2)), GROUP_BYTES):
                part, document, start, count, texts = [], [], [], [], []
                for piece in cut(group.offsets, group.data):
                    raw, low, doc, word, n, begin, end = super_kmers(piece, width, minimiser)
                    part.append((low >> np.uint64(20)) % np.uint64(parts))
                    document.append(doc + piece.first + group.first)
                    start.append(word)
                    count.append(n)
                    texts += [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                if not texts:
                    continue
                part, document, start, count = (np.concatenate(x) for x in (part, document, start, count))
                owner, earliest = ids[document], {}
                for text, doc in zip(texts, owner.tolist(), strict=True):
                    if earliest.setdefault(text, doc) > doc:
                        earliest[text] = doc
                first = np.fromiter((earliest[t] for t in texts), np.int64, len(texts)) == owner
                marks = _spans(owner[~first], hashes[document[~first]], start[~first], count[~first])
                if marks is not None:
                    yield _as_sent(marks, parts)
                kept = np.flatnonzero(first)
                kept = kept[np.argsort(part[kept], kind="stable")]
                edges = np.flatnonzero(np.diff(part[kept])) + 1
                groups = np.split(kept, edges)
                blobs = [pack(owner[g], hashes[document[g]], start[g], [texts[i] for i in g.tolist()]) for g in groups]
                n = len(blobs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[g[0]]) for g in groups], pa.int32()), pa.array(blobs, pa.binary())]
                    + [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())],
                    names=["part", "blob", "doc_id", "text_hash", "span_start", "span_words"])

    return send


def repeated_windows(blobs: list[bytes], width: int) -> pa.RecordBatch | None:
    """Marks of the windows of one part that also start in an earlier document.

    Windows are sorted by hash; neighbours with equal hashes are compared byte by
    byte, so a collision cannot make two windows equal.
    """
    unpacked = [unpack(b) for b in blobs]
    ids, hashes, starts, lengths = (np.concatenate([u[k] for u in unpacked]) for k in range(4))
    data = np.concatenate([u[4] for u in unpacked])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    keys, entries, places, begins, ends = [], [], [], [], []
    for piece in cut(offsets, data):
        found = words(piece, byte_tables(lower=False))
        at = window_starts(found.first, width)
        entry = np.searchsorted(found.first, at, "right") - 1
        keys.append(window_hashes(found.hashes, width)[at] if len(at) else np.zeros(0, np.uint64))
        entries.append(entry + piece.first)
        places.append(at - found.first[entry])
        begins.append(found.starts[at] + offsets[piece.first])
        ends.append(found.ends[at + width - 1] + offsets[piece.first])
    key, entry, place, begin, end = (np.concatenate(x) for x in (keys, entries, places, begins, ends))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if len(same) == 0:
        return None
    raw = memoryview(data.tobytes())
    left, right = order[same], order[same + 1]
    wrong = [i for i, (a, b, c, d) in enumerate(zip(begin[left].tolist(), end[left].tolist(), begin[right].tolist(), end[right].tolist(), strict=True))
             if raw[a:b] != raw[c:d]]
    if wrong:  # different windows of one hash: order them by their bytes
        bad = np.isin(key[order], key[left[wrong]])
        rows = order[bad]
        order[bad] = sorted(rows.tolist(), key=lambda i: (int(key[i]), bytes(raw[begin[i]: end[i]])))
        differs = np.array([key[a] != key[b] or raw[begin[a]: end[a]] != raw[begin[b]: end[b]]
                            for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)])
    else:
        differs = np.ones(len(order) - 1, bool)
        differs[same] = False
    head = np.concatenate([[0], np.flatnonzero(differs) + 1])
    owner = ids[entry[order]]
    earliest = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.append(head, len(order))))
    late = order[owner > earliest]
    e = entry[late]
    return _spans(ids[e], hashes[e], starts[e].astype(np.int64) + place[late], np.ones(len(late), np.int64))


def finder(width: int):
    """Handles one part after the other (rows come sorted by part) and passes marks on."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            marks = batch.filter(batch.column(1).is_null())
            if marks.num_rows:
                yield pa.RecordBatch.from_arrays(marks.columns[2:], names=["doc_id", "text_hash", "span_start", "span_words"])
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if held and (found := repeated_windows(held, width)) is not None:
                        yield found
                    part, held = p, []
                if blob.is_valid:
                    held.append(blob.as_py())
        if held and (found := repeated_windows(held, width)) is not None:
            yield found

    return find


def _only_held(held: np.ndarray):
    """Rows whose key, in the last column, the filter may hold."""
    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held, batch.column(batch.num_columns - 1).to_numpy())))

    return only


def _remove(width: int, without: np.ndarray | None = None):
    """Takes spans out of texts: rows (doc_id, text, spans), or (doc_id, text, key) of which a filter holds none."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if without is None:
                spans = batch.column(2).to_pylist()
            else:
                batch = batch.filter(pa.array(~may_hold(without, batch.column(2).to_numpy())))
                spans = [None] * batch.num_rows
            n_words, n_removed, kept = [], [], []
            for text, cover in zip(batch.column(1), spans, strict=True):
                found = (text.as_py() or b"").split()
                gone = np.zeros(len(found) + 1, np.int32)
                for span in cover or ():
                    gone[span["span_start"]] += 1
                    gone[span["span_start"] + span["span_words"] + width - 1] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                n_words.append(len(found))
                n_removed.append(len(found) - int(stays.sum()))
                kept.append(b" ".join([w for w, s in zip(found, stays.tolist(), strict=True) if s] if cover else found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return remove


def repeats(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER) -> DataFrame:
    """(doc_id, text_hash, span_start, span_words): windows whose words an earlier document has as a window.

    A window stands for ``width`` consecutive words; a span is a run of window
    starts. One shuffle takes packed super-k-mers to the part of their minimiser.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS_PER_PARTITION * partitions
    sent = docs.select(F.col("doc_id").cast("long"), _text_hash(), "text").mapInArrow(sender(parts, width, minimiser), _SENT)
    return sent.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(finder(width), _MARKS)


def _text_hash():
    """Tells rows of one doc_id apart; equal rows have equal marks."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("text_hash")


def remove_repeats(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row's text without the words that such windows cover.

    Windows are judged on the input, not on what is left. Words are what white space
    (space, tab to carriage return) separates; kept words are joined by one space.
    Null and empty texts have no words; fewer than ``width`` words make no window.
    Rows of one doc_id do not remove each other's words, and a row without id counts
    as later than every other.

    Texts are joined with their spans; a filter of fixed size lets most texts
    without any pass by that shuffle.
    """
    marks = (repeats(docs, width, minimiser).groupBy("doc_id", "text_hash")
             .agg(F.collect_list(F.struct("span_start", "span_words")).alias("spans"))
             .withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    marks = written(marks, "marks")
    key = F.xxhash64("_id", "_hash").alias("key")
    held = bloom(marks.select(key), "key")
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("_id"),
                        _text_hash().alias("_hash"), F.col("text").cast("binary").alias("text"))
    kept = "doc_id long, n_words long, n_removed long, kept binary"
    touched = keyed.select("*", key).mapInArrow(_only_held(held), "doc_id long, _id long, _hash long, text binary, key long")
    joined = touched.join(marks, ["_id", "_hash"], "left").select("doc_id", "text", "spans").mapInArrow(_remove(width), kept)
    return joined.unionByName(keyed.select("doc_id", "text", key).mapInArrow(_remove(width, held), kept))


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


