"""Exact vector search for a batch of queries.

The corpus is scanned once, in Arrow batches, against a query matrix that every
task holds; each task keeps its k best rows per query, so only
queries x k x tasks rows are shuffled for the final ranking. The queries are split
by hash into parts of a bounded size, one for a small set, with one scan each. The
driver holds one part at a time, a task one block of the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.runtime import BROADCAST_ROWS, BROADCAST_VALUES

CELLS = 4_000_000  # of the product that a task holds at a time (32 MB)
SCORE_DIGITS = 9  # equal vectors must tie whatever block of the product they fall in


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _query_parts(queries: DataFrame, dimension: int, limit_rows: int | None) -> Iterator[tuple]:
    """Query ids, scopes and unit vectors, in parts that each pass the size check; made one after the other."""
    bound = limit_rows or max(1, min(BROADCAST_ROWS, BROADCAST_VALUES // max(dimension, 1)))
    total = queries.count()
    # parts are half full on average, so a hash part does not exceed the bound; repeated rows of an id share a part
    n = 1 if total <= bound else 2 * -(-total // bound)
    slot = F.pmod(F.xxhash64("query_id", "vector"), F.lit(n))
    for i in range(n if total else 0):
        t = queries.filter(slot == i).limit(2 * bound + 1).toArrow()
        if t.num_rows > 2 * bound:
            raise ValueError("many queries repeat one id and vector: remove the copies first")
        if t.num_rows:
            yield t.column("query_id").to_pylist(), t.column("scope").to_pylist(), _unit(_matrix(t.column("vector")))


def _scan(corpus: DataFrame, part: tuple, k: int | None, floor: float | None) -> DataFrame:
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(part)
    by_name = {f.name: f.dataType for f in corpus.schema.fields}
    out_schema = T.StructType([
        T.StructField("query_pos", T.IntegerType()),
        T.StructField("id", by_name["id"]),
        T.StructField("score", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, scopes, matrix = shared.value
        scoped = any(s is not None for s in scopes)
        best: list[list[tuple]] = [[] for _ in scopes]
        kind = None
        step = max(1, CELLS // max(1, len(scopes)))
        for whole in batches:
            kind = whole.schema.field("id").type
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                scores = np.round(_unit(_matrix(batch.column("vector"))) @ matrix.T, SCORE_DIGITS) + 0.0
                ids = batch.column("id").to_pylist()
                if scoped:
                    owners = np.array(batch.column("scope").to_pylist(), dtype=object)
                hits_q, hits_id, hits_s = [], [], []
                for q, scope in enumerate(scopes):
                    column = scores[:, q]
                    rows = np.arange(len(column)) if scope is None else np.flatnonzero(owners == scope)
                    if floor is not None:
                        rows = rows[column[rows] > floor]
                        hits_q += [q] * len(rows)
                        hits_id += [ids[r] for r in rows]
                        hits_s += column[rows].tolist()
                        continue
                    if len(rows) > k:
                        cut = np.partition(column[rows], len(rows) - k)[len(rows) - k]
                        rows = rows[column[rows] >= cut]
                    merged = best[q] + [(-float(column[r]), ids[r]) for r in rows]
                    merged.sort()
                    best[q] = merged[:k]
                if floor is not None and hits_q:
                    yield _batch(hits_q, hits_id, hits_s, kind)
        if floor is None and kind is not None:
            flat = [(q, i, -s) for q, rows in enumerate(best) for s, i in rows]
            if flat:
                q, i, s = zip(*flat)
                yield _batch(list(q), list(i), list(s), kind)

    def _batch(q, i, s, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(i, kind), pa.array(s, pa.float64())],
            names=["query_pos", "id", "score"],
        )

    found = corpus.mapInArrow(run, out_schema)
    names = spark.createDataFrame(
        [(i, q) for i, q in enumerate(part[0])],
        T.StructType([T.StructField("query_pos", T.IntegerType()),
                      T.StructField("query_id", T.StringType() if isinstance(part[0][0], str) else T.LongType())]),
    )
    return found.join(F.broadcast(names), "query_pos").select("query_id", "id", "score")


def vector_search(
    corpus: DataFrame, queries: DataFrame, k: int, dimension: int, limit_rows: int | None = None
) -> DataFrame:
    """k nearest rows by cosine for every query: (query_id, id, score, rank).

    corpus(id, vector[, scope]); queries(query_id, vector[, scope]). A query
    with a scope sees only the corpus rows of that scope. Ties go to the lower id.
    """
    found = _search(corpus, queries, dimension, limit_rows, k, None)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vector_matches(
    corpus: DataFrame, queries: DataFrame, floor: float, dimension: int, limit_rows: int | None = None
) -> DataFrame:
    """All (query_id, id, score) with a cosine strictly above ``floor``."""
    return _search(corpus, queries, dimension, limit_rows, None, floor)


def _search(corpus, queries, dimension, limit_rows, k, floor) -> DataFrame:
    slim = corpus.select(
        "id", "vector", *(["scope"] if "scope" in corpus.columns else [F.lit(None).cast("string").alias("scope")])
    )
    asked = queries.select(
        "query_id", "vector",
        *(["scope"] if "scope" in queries.columns else [F.lit(None).cast("string").alias("scope")]),
    )
    found = None
    for part in _query_parts(asked, dimension, limit_rows):
        one = _scan(slim, part, k, floor)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return slim.limit(0).select(
            asked_id(asked), F.col("id"), F.lit(None).cast("double").alias("score")
        )
    return found


def asked_id(asked: DataFrame):
    kind = asked.schema["query_id"].dataType
    return F.lit(None).cast("string" if isinstance(kind, T.StringType) else "long").alias("query_id")
