"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.bloom import bloom, may_hold
from citeloom.llm.components import components
from citeloom.llm.words import byte_tables, mix, pieces, window_hashes, words
from citeloom.runtime import written

SHINGLE = 5
SIMILARITY = 75  # percent
# A pair at the threshold shares no band with probability (1 - 0.75**6)**50, 6 in 100,000.
BANDS, BAND_ROWS = 50, 6
BATCH = 30  # signature values compared at a time
MISS = 1e-6  # chosen probability that a batch drops a pair at or above the threshold

_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"
# Shingles that at most so many texts of mixed buckets hold are looked up, others counted.
RARE = 10

_SETS = "id long, d1 long, n long, shingles array<long>"


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (draw[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draw[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order.

    A text with fewer words than ``width`` has its whole sequence as one shingle, a
    text without words none.
    """
    tables = byte_tables(lower=True)
    for piece in pieces(column):
        found = words(piece, tables)
        hashes = window_hashes(found.hashes, width)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(hashes[a: b - width + 1])
            elif b > a:
                yield window_hashes(found.hashes[a:b], b - a, seed=b - a)
            else:
                yield np.zeros(0, np.uint64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order."""
    d1 = int(shingles.sum(dtype=np.uint64))
    d2 = int(mix(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64))
    return d1 - (1 << 64) * (d1 >> 63), d2 - (1 << 64) * (d2 >> 63)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest value of every hash function over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 2048):
        values = a[:, None] * x[None, k: k + 2048]
        values += b[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def _sketcher(bands: int, rows: int, width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors(bands * rows)
        for batch in batches:
            known: dict[tuple[int, int], tuple[np.ndarray, bytes]] = {}
            sizes, digests, keys, signatures = [], [], [], []
            for shingles in shingle_sets(batch.column(1), width):
                digest = set_digest(shingles)
                if digest not in known:
                    low = minhash(shingles, a, b)
                    key = np.zeros(bands, np.uint64)
                    for column in low.reshape(bands, rows).T:
                        key = mix(key + column)
                    known[digest] = (mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64), low.astype(np.uint8).tobytes())
                key, signature = known[digest]
                sizes.append(len(shingles))
                digests.append(digest)
                keys.append(key)
                signatures.append(signature)
            offsets = np.arange(len(sizes) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([d for d, _ in digests], pa.int64()), pa.array([d for _, d in digests], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
                 pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "signature"])

    return sketch


def least_matches(batches: int, batch: int, percent: int, miss: float) -> np.ndarray:
    """After each batch, the fewest matching values with which a pair goes on.

    With a uniform prior on the similarity, a pair is dropped once its posterior
    probability of reaching the threshold is below ``miss``. Values are bytes, so
    two different minima match once in 256.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    match = grid + (1 - grid) / 256
    enough = grid >= percent / 100
    least = []
    for k in range(1, batches + 1):
        n = k * batch
        m = np.arange(n + 1)[:, None]
        log = m * np.log(match) + (n - m) * np.log1p(-match)
        mass = np.exp(log - log.max(axis=1, keepdims=True))
        chance = mass[:, enough].sum(axis=1) / mass.sum(axis=1)
        least.append(int(np.argmax(chance >= miss)))
    return np.array(least)


def pruner(bands: int, rows: int, percent: int, miss: float):
    """Compares two signature columns batch by batch and keeps the pairs that may reach the threshold."""
    total = bands * rows
    least = least_matches(total // BATCH, BATCH, percent, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, total) for c in (6, 7))
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            alive = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            matches = np.zeros(len(alive), np.int64)
            for k, needed in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches += (left[alive, part] == right[alive, part]).sum(axis=1)
                stays = matches >= needed
                alive, matches = alive[stays], matches[stays]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in range(4)], names=["a", "da", "b", "db"])

    return prune


def _setter(held: np.ndarray, width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.flatnonzero(may_hold(held, batch.column(1).to_numpy()))
            some = batch.take(pa.array(wanted))
            for k in range(0, some.num_rows, 500):
                part = some.slice(k, 500)
                found = list(shingle_sets(part.column(2), width))
                sizes = np.array([len(s) for s in found], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                                 pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_digest(s)[0] for s in found], pa.int64()), pa.array(sizes), lists],
                                                 names=["id", "d1", "n", "shingles"])

    return sets


def shingle_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, d1, n, shingles) of the documents whose id is in ``ids``, made again from the text, as a written table.

    A filter of fixed size skips most other texts; of those it lets through by
    mistake the rows are simply never joined.
    """
    keys = ids.select(F.xxhash64("id").alias("key"))
    texts = docs.select("doc_id", F.xxhash64("doc_id").alias("key"), "text").where(F.col("doc_id").isNotNull())
    return written(texts.mapInArrow(_setter(bloom(keys, "key"), width), _SETS).dropDuplicates(["id", "d1"]), "shingle-sets")


def _linker(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return linked


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, sets: DataFrame | None, bands: int, rows: int, width: int, percent: int,
             miss: float) -> DataFrame:
    """The pairs (a, b) of document ids whose full shingle sets reach the threshold, as a written table.

    Only documents of pairs that the signatures leave open get their sets made again
    from the text, unless ``sets`` has them.
    """
    sides = reps.select("id", "n_shingles", "d1", "signature")
    open_ = (pairs.join(sides.toDF("a", "na", "da", "sa"), "a").join(sides.toDF("b", "nb", "db", "sb"), "b")
             .select("a", "da", "b", "db", "na", "nb", "sa", "sb").mapInArrow(pruner(bands, rows, percent, miss), "a long, da long, b long, db long"))
    open_ = written(open_, "open-pairs")
    if sets is None:
        sets = shingle_table(docs, open_.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    side = sets.select("id", "d1", "shingles")
    both = (open_.join(side.toDF("a", "da", "xa"), ["a", "da"]).join(side.toDF("b", "db", "xb"), ["b", "db"]).select("a", "b", "xa", "xb"))
    return written(both.mapInArrow(_linker(percent), "a long, b long").distinct(), "links")


def crossing_pairs(placed: DataFrame, sets: DataFrame, reps: DataFrame, percent: int, rare: int = RARE) -> DataFrame:
    """Pairs (a, b) of different components that may still be linked, from buckets that hold several.

    ``placed``: (key, id, leader, component). Two linked sets x and y overlap in at
    least percent / (100 + percent) of their sizes' sum. Either they share a
    shingle that few texts hold: such pairs come from a join on rare shingles, at
    most ``rare`` partners each. Or all they share is common: then both must have
    enough common shingles, which most texts of a large group of edited copies do
    not, so that group's pairs are never made. The bounds are exact. Of the buckets
    that a pair shares, only the first makes it.
    """
    members = written(placed.select("id", "component").distinct().join(sets.select("id", "d1", "n", "shingles"), "id"), "mixed-members")
    held = members.select("id", "d1", "n", "component", F.explode("shingles").alias("shingle"))
    many = held.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    held = written(held.join(many, "shingle"), "shared-shingles")
    room = held.groupBy("id", "d1").agg(F.count("*").alias("shared"), F.count(F.when(F.col("texts") > rare, 1)).alias("common"))

    def reach(bound: str) -> str:
        return f"{100 + percent} * least(x.{bound}, y.{bound}) >= {percent} * (x.n + y.n)"

    few = held.where(F.col("texts") <= rare).join(room.select("id", "d1", "shared"), ["id", "d1"])
    looked_up = (few.alias("x").join(few.alias("y"), F.expr(f"x.shingle = y.shingle and x.id < y.id and x.component != y.component and {reach('shared')}"))
                 .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))

    sized = members.select("id", "d1", "n").join(room.select("id", "d1", "common"), ["id", "d1"])
    able = placed.join(sized.groupBy("id").agg(F.min("n").alias("n"), F.max("common").alias("common")), "id")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m")).select("key", F.col("m.component").alias("main"))
    able = able.where(f"100 * common >= {percent} * n and id != leader").join(reps.select("id", "bands"), "id")
    minor = able.join(main, "key").where("component != main")
    counted = (minor.alias("x").join(able.alias("y"), F.expr(
        f"x.key = y.key and x.component != y.component and (y.component = x.main or x.id < y.id) and {reach('common')} "
        "and x.key = get(filter(zip_with(x.bands, y.bands, (p, q) -> if(p = q, p, null)), v -> v is not null), 0)"))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    return written(looked_up.unionByName(counted).distinct(), "crossing-pairs")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, width: int = SHINGLE, percent: int = SIMILARITY,
                    miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    1. Every text becomes a set of hashed shingles, a signature and band keys. Texts
       of equal sets are one class, represented by its smallest doc_id.
    2. In every band bucket each representative is paired with the bucket's smallest
       one: pairs grow with the rows of a bucket, not with its square.
    3. Pairs are pruned by signature and verified on full sets; links give components.
    4. Buckets that then hold more than one component are completed: members
       outside the bucket's main component meet the members of other components,
       but for pairs that exact bounds rule out. So no candidate pair is left out
       unless its ends are connected already or cannot be linked.

    Texts without words have no shingles and no links. Documents without id take
    the component of their equal texts, or null. Rows of one doc_id are told apart
    by their sets. Further columns are not used.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(docs.mapInArrow(_sketcher(bands, rows, width), _SKETCH), "sketches")
    classes = written(table.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "classes")
    reps = table.join(classes, ["d1", "d2"]).where(F.col("doc_id") == F.col("id")).dropDuplicates(["d1", "d2"])
    reps = written(reps.select("id", "n_shingles", "d1", "bands", "signature"), "representatives")

    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(keyed.join(shared, "key"), "members")
    options = (bands, rows, width, percent, miss)
    stars = members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = verified(stars, reps, docs, None, *options)

    found = components(links)
    placed = members.join(found, "id", "left").select("key", "id", "leader", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    placed = written(placed.join(mixed, "key"), "mixed-buckets")
    sets = shingle_table(docs, placed.select("id").distinct(), width)
    crossing = crossing_pairs(placed, sets, reps, percent)
    if not crossing.isEmpty():
        links = links.unionByName(verified(crossing, reps, docs, sets, *options))
        found = components(links)

    by_class = classes.join(found, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    out = table.select("doc_id", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for. Columns stay.

    An id goes only if none of its rows is kept; rows that repeat an id and its text
    are one document and stay together.
    """
    gone = (near_duplicates(docs, **options).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept"))
            .where(~F.col("_kept")).select("_gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
