"""Structured Streaming over append-only logs, with the same aggregates as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.files import shared_folder


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet file or folder at ``path``, with its schema.

    The path is given as a pattern that only it meets, as a stream takes one file only by a pattern.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], measures: list[Column], late: str = "1 hour") -> DataFrame:
    """Measures by window and keys; rows later than ``late`` behind the newest are dropped, which bounds the state."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(*measures)
    return grouped.select(F.col("w.start").alias("start"), *(c for c in grouped.columns if c != "w"))


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], measures: list[Column], late: str = "1 hour") -> DataFrame:
    """Measures by session: rows of a key that follow each other within ``gap``."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(*measures)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *(c for c in grouped.columns if c != "w"))


def distinct_recent(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows without repeats of their keys within the watermark."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there now and return the result, kept as Parquet in the shared folder.

    A restarted query goes on from its own checkpoint there. Mode append gives what is
    final, complete the whole aggregate.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
