"""Sampling in rounds: a stream of listed files, a byte budget that all rounds share, and what was taken so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.io import materialize
from corpusloom.operators.select import as_is_fill

TAKEN = "file_id string, size_bytes long, round long"


def read_taken(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(TAKEN).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TAKEN)


def take_round(batch: DataFrame, batch_id: int, path: str, cap: int, identifier: str, size: str, order: list[str]) -> None:
    """One round: rows that still fit are added to what was taken, in a folder of the round, so that a round run again replaces itself."""
    spark = batch.sparkSession
    before = materialize(read_taken(spark, path).filter(F.col("round") != batch_id), "taken")
    used = before.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    fresh = batch.join(before.select(F.col("file_id").alias(identifier)), identifier, "left_anti")
    taken = as_is_fill(fresh, size, cap, identifier, order, used)
    taken.select(F.col(identifier).cast("string").alias("file_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size_bytes")).write.mode("overwrite").parquet(f"{path}/round={batch_id}")


def sample_stream(stream: DataFrame, path: str, checkpoint: str, cap: int, identifier: str = "drive_file_id", size: str = "size_bytes", order: tuple[str, ...] = ("path",)) -> StreamingQuery:
    """Takes files of a stream until the budget is full; restarts go on where they stopped, by the stream's checkpoint and the rounds taken."""
    run = lambda batch, n: take_round(batch, n, path, cap, identifier, size, list(order))
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by time window and key; rows later than ``late`` are left out by the watermark. Ours: the inventory itself has no event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
