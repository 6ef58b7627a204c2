"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import written

LAW = "bytes"
RECORD_BYTES = 16  # what a document takes besides its text


def text_bytes(text: Column) -> Column:
    """UTF-8 length of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size and checksum of every document; only these travel."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), (text_bytes(F.col(text)) + RECORD_BYTES).alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"))


def assign_shards(items: DataFrame, shards: int, order: tuple[str, ...] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """Adds ``shard`` and ``slot`` to items with a ``size``.

    Items are put into range partitions of ``order``; each partition's bytes and
    rows are summed, the sums are summed up over partitions (one row per
    partition), and a window inside each partition gives every item its global
    byte offset. The whole is cut at equal byte targets: an item belongs to the
    shard in which its middle byte falls, so a shard differs from the target by at
    most one item. Slots number a shard's items in order from 0.

    Null keys come first; equal rows are interchangeable, and a salt spreads a
    key that many rows share over partitions. An empty table gives an empty one.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (items.withColumn("_salt", F.monotonically_increasing_id())
              .repartitionByRange(parts, *keys, F.col("_salt")).withColumn("_part", F.spark_partition_id()))
    stored = written(ranged, "sharding-ranges")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(upto), F.lit(0)).alias("_bytes_before"),
                            F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_rows_before"))
    whole = stored.agg(F.sum("size").alias("_total"))
    inside = Window.partitionBy("_part").orderBy(*keys, "_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per range partition, and a single row: bounded by the partition count.
    placed = (stored.withColumns({"_upto": F.sum("size").over(inside), "_row": F.count("*").over(inside)})
              .join(F.broadcast(offsets), "_part").join(F.broadcast(whole))
              .withColumn("_middle", 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size"))
              .withColumn("shard", F.expr(f"cast(least(_middle * {shards} div (2 * _total), {shards - 1}) as int)"))
              .withColumn("_rank", F.col("_rows_before") + F.col("_row") - 1)
              .drop("_salt", "_part", "_upto", "_row", "_bytes_before", "_rows_before", "_total", "_middle"))
    placed = written(placed, "sharding-ranks")
    starts = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_rank") - F.col("_start")).drop("_rank", "_start")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: shard, slot in the shard, size and checksum of the text.

    The law is ``bytes``: shard sizes are near equal. Shards are contiguous in
    doc_id order. Further columns of the input are not used.
    """
    return assign_shards(sized(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
