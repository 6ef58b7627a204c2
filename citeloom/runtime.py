"""Session, checkpoint and size-check helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Upper bounds for what may be collected to the driver and shipped to tasks.
BROADCAST_ROWS = 20_000
BROADCAST_VALUES = 8_000_000  # rows x dimension of a query matrix (64 MB of doubles)
STORED_AS = "zstd"  # ids and numbers as text take about two thirds of what the default codec needs


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "citeloom") -> SparkSession:
    """A local session with the settings the operators expect."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "100000")  # limits per group are cut before the shuffle
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``; where that
    is unset, a local session takes a temporary one and any other is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
            "spark.checkpoint.dir"
        )
        context.setCheckpointDir(configured or _local_folder(spark, "citeloom-checkpoint-"))
    return df.checkpoint(eager=True)


def _local_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder of this machine, which only a local session may use."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, beside the checkpoints."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    app = spark.sparkContext.applicationId
    if configured is None and app not in _SCRATCH:
        _SCRATCH[app] = _local_folder(spark, "citeloom-scratch-")
    base = configured or _SCRATCH[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a scan has fewer splits than there are cores (few, small files).

    Large inputs have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Store an intermediate result as a table beside the checkpoints and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the real
    size: a later join broadcasts it only if it is below the session's
    threshold and shuffles it otherwise.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder, compression=STORED_AS)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_SCRATCH: dict[str, str] = {}


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Numbers the rows of every group from 1 in ``order``, however large a group is.

    Rows are range-partitioned by group and order and written; counts per part and
    group (one row each) say how many rows of a group lie in earlier parts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    stored = written(ranged, "ranges")
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored.groupBy("_part", *keys).agg(F.count("*").alias("_n")).select("_part", *keys, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    return stored.join(before, ["_part", *keys]).withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("int")).drop("_part", "_before")


def counted(df: DataFrame, key: str) -> DataFrame:
    """(key, n): rows per key, in tasks whose memory does not grow with what an input task reads.

    Rows are combined batch by batch, so that a frequent key sends a row per batch, and dealt by key;
    each task then counts its own keys only.
    """
    def combined(batches):
        for batch in batches:
            counts = batch.column(0).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=[key, "n"])

    parts = df.select(key).mapInArrow(combined, f"{key} {dict(df.dtypes)[key]}, n long")
    return parts.repartition(key).groupBy(key).agg(F.sum("n").alias("n"))


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str, salts: int = 0
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``, numbered from 1 in ``rank``.

    With ``salts`` a group is first cut to ``k`` rows in ``salts`` independent
    slices, so that one hot group never lands in a single task before the cut.
    Slices are sets of input tasks: each task's own cut is then k rows per group.
    """
    if salts > 1:
        sliced = df.withColumn("_salt", F.spark_partition_id() % salts)
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            sliced.withColumn("_cut", F.row_number().over(inner))
            .filter(F.col("_cut") <= k)
            .drop("_salt", "_cut")
        )
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)
