"""Keyword search over a stored index: postings in blocks with best counts, kept up to date per batch.

The index is part of a snapshot store, so it can change in one commit with the nodes.
Nodes are dealt to shards by their id. A node's words lie with its length, and postings
are made of them: a batch rewrites only the shards of its own nodes, and what moves
is a row per node, never a posting. Postings name a node by its number, which holds for one
version of its shard. A block holds postings of one word of similar
weight; its greatest count and least length bound what any of its nodes can
get from the word, whatever the statistics are by then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.search import K1, B, SLACK, alike, for_all, leading, terms, weight
from citeloom.runtime import top_k_per_group, written
from citeloom.settings import DEFAULTS, SEARCH_LABELS
from citeloom.sources.snapshots import Change, Snapshots, Table

SHARDS = 64
BLOCK = 128         # postings a block holds at most
LEVELS = 16         # of weight that are told apart in blocks
USUAL_WORDS = 64.0  # length the levels refer to; they only group what is alike
PASS = 1_000_000    # words a task sorts at a time
PUSHED_TERMS = 500  # as many words are handed to the scan, more are joined

_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
POSTING = T.StructType().add("number", _LONG).add("tf", _LONG).add("n_words", _INT)
INDEX_TABLES = {
    "lengths": Table(
        T.StructType().add("shard", _INT).add("node_id", _STR).add("label", _STR).add("n_words", _INT).add("number", _LONG).add("words", _STR),
        ("shard",), dealt=True,
    ),
    "blocks": Table(
        T.StructType().add("shard", _INT).add("label", _STR).add("term", _STR).add("held", _LONG).add("top_tf", _LONG)
        .add("low_words", _INT).add("postings", T.ArrayType(POSTING)),
        ("shard",), order=("label", "term"),
    ),
}
GROUP = ["shard", "label", "term", "level"]
NODE = ["shard", "number"]


def _shard() -> Column:
    return F.pmod(F.hash("node_id"), F.lit(SHARDS))


def index_texts(change: Change, texts: DataFrame) -> Change:
    """Stages texts(node_id, label, text): new nodes enter the index, known ones are indexed anew.

    Node ids are unique. A null text is empty; a node without words counts in the
    statistics of its label. Further columns are ignored.
    """
    found = texts.select("node_id", "label", F.sort_array(terms(F.col("text"))).alias("found"))
    return _reindexed(change, found.select("node_id", "label", F.size("found").alias("n_words"), F.array_join("found", " ").alias("words")))


def unindex(change: Change, gone: DataFrame) -> Change:
    """Stages the removal of the nodes gone(node_id)."""
    none = {"label": _STR, "n_words": _INT, "words": _STR}
    return _reindexed(change, gone.select("node_id").distinct().withColumns({c: F.lit(None).cast(t) for c, t in none.items()}))


def _reindexed(change: Change, rows: DataFrame) -> Change:
    """Stages rows(node_id, label, n_words, words), without words for nodes that go, and the blocks of their shards."""
    change.merge("lengths", written(rows.withColumn("shard", _shard()), "words"), _replaced, stored=True)
    return change.derive("blocks", "lengths", _inverted)


def _replaced(stored: DataFrame, incoming: DataFrame, bucket: Column, slices: int) -> DataFrame:
    """The stored nodes with the incoming ones in their place, dealt by bucket and numbered anew."""
    columns = ["shard", "node_id", "label", "n_words", "words"]
    rows = stored.select(*columns, F.lit(False).alias("new")).unionByName(incoming.select(*columns, F.lit(True).alias("new")))
    part = (bucket * slices + F.pmod(F.xxhash64("node_id"), F.lit(slices))).cast("int")
    # the shard follows from the id again behind the shuffle
    dealt = rows.withColumn("part", part).drop("shard").repartition("part")
    newest = Window.partitionBy("part", "node_id").orderBy(F.desc("new"))
    kept = dealt.withColumn("age", F.rank().over(newest)).filter((F.col("age") == 1) & F.col("words").isNotNull())
    return kept.withColumn("shard", _shard()).withColumn("number", F.monotonically_increasing_id())


def _inverted(lengths: DataFrame) -> DataFrame:
    """Blocks of the words of nodes, made by the task that reads them."""
    words = lengths.filter(F.col("n_words") > 0).select("shard", "label", "number", "n_words", F.explode(F.split("words", " ")).alias("term"))
    return words.mapInArrow(lambda batches: _cut(_alike_together(batches)), INDEX_TABLES["blocks"].schema)


def _alike_together(batches):
    """Postings of ``PASS`` words at a time, sorted so that those of a group lie side by side.

    The words of a node come in order, one after another; more than ``PASS`` are kept only for a longer text.
    """
    waiting, n = [], 0
    for batch in batches:
        waiting, n = waiting + [batch], n + len(batch)
        if n >= PASS:
            rows = pa.Table.from_batches(waiting)
            ends = _changes(rows, ["shard", "number"])  # the last node may go on
            yield from _counted(rows.slice(0, ends[-1]))
            rest = rows.slice(ends[-1]).combine_chunks()
            waiting, n = rest.to_batches(), len(rest)
    if n:
        yield from _counted(pa.Table.from_batches(waiting))


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """The first row and all that differ in a column from the row before."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for c in columns:
        values = rows[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _counted(words: pa.Table) -> list[pa.RecordBatch]:
    """A posting for every distinct word of a node, sorted by word, shard, label and level."""
    if not len(words):
        return []
    codes = {c: words[c].combine_chunks().dictionary_encode() for c in ("term", "label")}
    codes = {c: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for c, a in codes.items()}
    words = words.append_column("code", pa.array(codes["term"].indices.to_numpy().astype("int64")))
    firsts = _changes(words, ["shard", "number", "code"])
    tf = np.diff(np.append(firsts, len(words)))
    rows = words.take(pa.array(firsts))
    level = np.floor(LEVELS * tf / (tf + K1 * (1 - B + B * rows["n_words"].to_numpy() / USUAL_WORDS))).astype("int64")
    label = pc.fill_null(codes["label"].indices, len(codes["label"].dictionary)).to_numpy().astype("int64")[firsts]
    labels = len(codes["label"].dictionary) + 1
    key = ((rows["code"].to_numpy() * SHARDS + rows["shard"].to_numpy()) * labels + label) * (LEVELS + 1) + level
    postings = rows.select(["shard", "label", "term", "n_words"]).append_column("node_id", rows["number"])
    postings = postings.append_column("tf", pa.array(tf)).append_column("level", pa.array(level))
    return postings.take(pa.array(np.argsort(key, kind="stable"))).combine_chunks().to_batches()


def _cut(batches):
    """Blocks of at most ``BLOCK`` postings from rows that lie sorted by word, shard, label and level.

    ``node_id`` is whatever names a node in postings.
    """
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        if not len(rows):
            continue
        starts = _starts(rows)
        if starts[-1]:
            yield _blocks(rows.slice(0, starts[-1]), starts[:-1])
        rest = rows.slice(starts[-1])  # the last block may go on
    if rest is not None:
        yield _blocks(rest, np.array([0]))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where blocks begin: at a new group, and ``BLOCK`` rows after the last start."""
    n = len(rows)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in GROUP:
        values = rows[c].combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        # rows without a label are found by no search; each is a block
        changed = pc.fill_null(pc.not_equal(values.slice(1), values.slice(0, n - 1)), True)
        new[1:] |= changed.to_numpy(zero_copy_only=False)
    firsts = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))
    return np.flatnonzero(place % BLOCK == 0)


def _blocks(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    tf, n_words = rows["tf"].to_numpy(), rows["n_words"].to_numpy()
    ends = np.append(starts, len(rows))

    def flat(c: str, type_=None):
        values = pa.concat_arrays(rows[c].chunks)
        return values if type_ is None else values.cast(type_)

    held = pa.StructArray.from_arrays([flat("node_id"), flat("tf", pa.int64()), flat("n_words", pa.int32())], names=[f.name for f in POSTING.fields])
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays([
        flat("shard", pa.int32()).take(first), flat("label").take(first), flat("term").take(first), pa.array(np.diff(ends).astype("int64")),
        pa.array(np.maximum.reduceat(tf, starts).astype("int64")), pa.array(np.minimum.reduceat(n_words, starts).astype("int32")),
        pa.ListArray.from_arrays(pa.array(ends.astype("int32")), held),
    ], names=[f.name for f in INDEX_TABLES["blocks"].schema.fields])


def _opened(blocks: DataFrame) -> DataFrame:
    kept = [c for c in blocks.columns if c != "postings"]
    return blocks.select(*kept, F.inline("postings"))


def search_stored(
    store: Snapshots, queries: DataFrame, limit: int = DEFAULTS.search_limit, labels: list[str] | None = None,
    within: DataFrame | None = None,
) -> DataFrame:
    """As ``search`` over the indexed texts: (query_id, node_id, label, score, rank).

    Only blocks of asked words are read. The best blocks of every word give each query
    a score its top nodes reach at least; a block is opened for candidates only if its bound and
    the best other words can give together reach it.
    """
    lengths, blocks = store.read("lengths"), store.read("blocks")
    if labels is not None:
        unknown = set(labels) - set(SEARCH_LABELS)
        if unknown:
            raise ValueError(f"unknown entity type: {sorted(unknown)}")
        lengths, blocks = lengths.filter(F.col("label").isin(*labels)), blocks.filter(F.col("label").isin(*labels))
    named = lengths.select("shard", "number", "node_id")
    sizes = lengths.groupBy("label").agg(F.count("*").alias("n_docs"), F.avg("n_words").alias("mean_words"))
    asked = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")), "terms")
    vocabulary = asked.select("term").distinct()
    few = vocabulary.limit(PUSHED_TERMS + 1).collect()
    if len(few) <= PUSHED_TERMS:
        blocks = blocks.filter(F.col("term").isin(*[r[0] for r in few]) if few else F.lit(False))
    read = blocks.join(vocabulary, "term", "left_semi")
    spread = read.groupBy("label", "term").agg(F.sum("held").alias("df"))
    facts = written(spread.join(sizes, "label"), "facts")  # a row per asked word
    bound = weight(F.col("top_tf"), F.col("low_words"), F.col("df"))
    bounded = written(read.join(facts, ["label", "term"]).withColumn("bound", bound), "bounded")

    allowed = None if within is None else written(named.join(within.select("node_id"), "node_id", "left_semi").drop("node_id"), "allowed")

    def opened(part: DataFrame) -> DataFrame:
        rows = _opened(part).withColumn("w", weight(F.col("tf"), F.col("n_words"), F.col("df")))
        return rows if allowed is None else rows.join(allowed, NODE, "left_semi")

    best = written(bounded.groupBy("label", "term").agg(F.max("bound").alias("best")), "best")
    same = alike(asked, best)
    by_best = Window.partitionBy("query_id", "label").orderBy(F.desc("best"), "term")
    of_query = Window.partitionBy("query_id", "label")
    terms_of = written(asked.join(best, "term").join(leading(same), ["query_id", "label"], "left_semi").select(
        "query_id", "label", "term",
        F.sum("best").over(by_best.rowsBetween(0, Window.unboundedFollowing)).alias("still_possible"),
        (F.sum("best").over(of_query) - F.col("best")).alias("others"),
    ), "query-terms")
    # every block holds a posting, so the first ``limit`` of a word hold as many
    first = top_k_per_group(bounded, ["label", "term"], [F.desc("bound")], limit, "_place").drop("_place")
    probed = terms_of.select("query_id", "label", "term").join(opened(first), ["label", "term"]).groupBy(
        "query_id", "label", *NODE).agg(F.sum("w").alias("part"))
    reached = (
        top_k_per_group(probed, ["query_id", "label"], [F.desc("part"), *NODE], limit, "_place")
        .filter(F.col("_place") == limit).select("query_id", "label", F.col("part").alias("reached"))
    )
    needed = terms_of.join(reached, ["query_id", "label"], "left").withColumn("needed", F.coalesce("reached", F.lit(0.0)) - SLACK)
    deciding = written(needed.filter(F.col("still_possible") >= F.col("needed")), "deciding")
    # a block is opened once for all queries that need it: the least demanding one decides on it
    least = written(deciding.groupBy("label", "term").agg(F.min(F.col("needed") - F.col("others")).alias("least")), "least")
    opening = opened(bounded.join(least, ["label", "term"]).filter(F.col("bound") >= F.col("least")))
    chosen = written(
        deciding.join(opening.select("label", "term", *NODE, "w"), ["label", "term"])
        .filter(F.col("w") + F.col("others") >= F.col("needed")).select("query_id", "label", *NODE).distinct(),
        "candidates",
    )
    wanted = written(chosen.select("label", *NODE).distinct(), "wanted")
    weights = _opened(bounded).join(wanted, ["label", *NODE], "left_semi").select(
        "label", *NODE, "term", weight(F.col("tf"), F.col("n_words"), F.col("df")).alias("w"))
    scored = (
        chosen.join(weights, ["label", *NODE]).join(asked, ["query_id", "term"])
        .groupBy("query_id", "label", *NODE).agg(F.round(F.sum("w"), 6).alias("score"))
        .join(named, NODE).drop(*NODE)
    )
    order = [F.desc("score"), F.col("node_id")]
    per_label = top_k_per_group(scored, ["query_id", "label"], order, limit, "_in_label").drop("_in_label")
    return top_k_per_group(for_all(per_label, same), ["query_id"], order, limit, "rank")
