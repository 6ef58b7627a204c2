"""Vector columns: pairwise cosine, centroids, and a deterministic text embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0; the shorter length decides."""
    size = F.least(F.size(a), F.size(b))
    dot = F.aggregate(
        F.slice(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(1), size),
        F.lit(0.0), lambda s, x: s + x,
    )
    norm = F.sqrt(_squares(a)) * F.sqrt(_squares(b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def _squares(a: Column) -> Column:
    return F.aggregate(
        F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def centroids(df: DataFrame, key: str, vector: str, out: str = "centroid") -> DataFrame:
    """Mean vector per key: averages per (key, position), then one short array per key."""
    parts = (
        df.select(key, F.posexplode(vector).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return parts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(out)
    )


def hashing_embedder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """Feature hashing of words into ``dimension`` signed buckets, unit length."""

    @lru_cache(maxsize=200_000)
    def place(word: str) -> tuple[int, float]:
        code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return (code >> 1) % dimension, 1.0 if code & 1 else -1.0

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in enumerate(texts):
            for word in _WORD.findall((text or "").lower()):
                bucket, sign = place(word)
                out[row, bucket] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)

    return embed


def embed(text: Column, dimension: int, model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Column:
    """Embed a text column in Arrow batches.

    ``model`` builds the embedding function; it is called once per Python
    worker stream (warm-up), not once per batch. Default: feature hashing.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        function = model() if model else hashing_embedder(dimension)
        for batch in batches:
            vectors = function(batch.fillna("").tolist())
            yield pd.Series(list(np.asarray(vectors, dtype="float32")), index=batch.index)

    return run(text)
