"""A filter of fixed size over any number of keys, built by Spark.

It only saves work: what passes is joined with the keys afterwards, so its false
positives never reach a result, and its size does not depend on the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # a megabyte


def bloom(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The filter's 64-bit words; at most ``bits`` / 64 rows come to the driver.

    ``column`` holds 64-bit hashes whose bits are well spread.
    """
    k, mask = F.col(column), F.lit(bits - 1).cast("long")
    at = F.explode(F.array(k.bitwiseAND(mask), F.shiftrightunsigned(k, 32).bitwiseAND(mask)))
    parts = (keys.where(k.isNotNull()).select(at.alias("at"))
             .groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("value")))
    table = parts.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table["word"].to_numpy()] = table["value"].to_numpy()
    return out


def may_hold(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be among the keys."""
    k = hashes.view(np.uint64)
    mask = np.uint64(len(filter_words) * 64 - 1)
    found = np.ones(len(k), bool)
    for at in (k & mask, (k >> np.uint64(32)) & mask):
        at = at.astype(np.int64)
        found &= ((filter_words[at >> 6] >> (at & 63)) & 1).astype(bool)
    return found
