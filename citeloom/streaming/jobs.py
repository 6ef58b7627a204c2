"""Ingestion jobs as a stream, job states, and request limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from citeloom.schema import JOB_STATUS


def stream_tables(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                  files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def ingest(arrivals: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "paper_id") -> StreamingQuery:
    """Run ``work`` on the new papers of each micro-batch; rows go to ``target``, job states beside it (see ``states_folder``).

    Which papers came before is keyed state of the stream, in its checkpoint: a
    micro-batch reads nothing of the target, however large that is. Rows and states
    are written under their batch number, and a batch that is repeated after a
    failure starts from the state before it, so it overwrites its own output. A paper
    without rows has failed. Use the RocksDB state store (a session setting) where
    keys outgrow memory.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # used twice; what is lost of it is made again from the state before
        rows, names = f"{target}/batch_id={batch_id}", batch.select(F.col(key).alias("job_id"))
        done = work(batch)
        done.write.mode("overwrite").parquet(rows)
        kept = spark.read.schema(done.schema).parquet(rows).select(F.col(key).alias("job_id")).distinct().withColumn("_kept", F.lit(True))
        status = F.explode(F.array(F.lit("queued"), F.when(F.col("_kept"), "completed").otherwise("failed")))
        states = names.join(kept, "job_id", "left").select("job_id", status.alias("status"), F.current_timestamp().alias("ts"))
        states.write.mode("overwrite").parquet(f"{states_folder(target)}/batch_id={batch_id}")
        batch.unpersist()

    fresh = arrivals.dropDuplicates([key])
    return fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states_folder(target: str) -> str:
    """Where ``ingest`` keeps the history (job_id, status, ts) of the jobs whose rows go to ``target``."""
    return f"{target.rstrip('/')}-states"


def latest_status(history: DataFrame) -> DataFrame:
    """Last state per job: history(job_id, status, ts[, error]); later steps win equal times."""
    step = F.array_position(F.array(*[F.lit(s) for s in JOB_STATUS]), F.col("status"))
    fields = [c for c in history.columns if c != "job_id"]
    return history.groupBy("job_id").agg(F.max_by(F.struct(*fields), F.struct("ts", step)).alias("last")).select("job_id", "last.*")


def valid_transition(before: Column, after: Column) -> Column:
    """A job moves forward through the states; failed is reachable from any unfinished one."""
    at = lambda c: F.array_position(F.array(*[F.lit(s) for s in JOB_STATUS]), c)
    final = before.isin("completed", "failed")
    return ~final & ((after == "failed") | ((at(after) > at(before)) & (after != "failed")))


def outcome(parsed: Column, extracted: Column) -> Column:
    """struct<paper_status, job_status, keep_chunks> of the two failure domains."""
    return F.struct(
        F.when(parsed, "completed").otherwise("failed").alias("paper_status"),
        F.when(parsed & extracted, "completed").otherwise("failed").alias("job_status"),
        parsed.alias("keep_chunks"),
    )


def over_limit(requests: DataFrame, per_window: int, window: str = "1 minute", keys: tuple[str, ...] = ("client",)) -> DataFrame:
    """Clients above their limit in a fixed window; works on tables and streams.

    requests(client, ts). Partial counts are combined before the shuffle, so a
    client with most requests is no hot spot.
    """
    counted = requests.groupBy(*keys, F.window("ts", window)).agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > per_window).select(*keys, F.col("window.start").alias("window_start"), "requests")


def recent_requests(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the same client in the ``seconds`` up to and including each request: adds ``recent``.

    requests(request_id, client, ts). Time is cut into slots of that length and
    each request is also shown to the next slot, so a window never sorts more
    than two slots of one client.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = seconds * 1_000_000
    placed = requests.withColumn("at", micros).withColumn(
        "slot", F.explode(F.array(F.floor(F.col("at") / span), F.floor(F.col("at") / span) + 1))
    )
    near = Window.partitionBy("client", "slot").orderBy("at").rangeBetween(-span, 0)
    counted = placed.withColumn("recent", F.count("*").over(near))
    return counted.filter(F.col("slot") == F.floor(F.col("at") / span)).drop("at", "slot")


def waits(requests: DataFrame, per_minute: int) -> DataFrame:
    """Requests that a limiter of n per minute would have held back."""
    return recent_requests(requests).filter(F.col("recent") > per_minute)
