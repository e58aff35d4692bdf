"""Tables and folders taken in as they grow: each run takes what is new and stops."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint_dir


def ingest(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch of new rows to ``write(rows, batch id)``; the checkpoint remembers what was taken."""
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of text files: filename, path, text."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.decode("content", "UTF-8").alias("text"))


def hourly_counts(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """window_start, event_type, n: tumbling windows of an hour over an event table read as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    target = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    spark.createDataFrame([], "window_start timestamp_ntz, event_type string, n bigint").write.parquet(f"{target}/out/batch=-1")  # an empty stream has no batch

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/out/batch={number}")

    # only windows that changed are written, and the watermark lets go of old ones
    query = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema("window_start timestamp_ntz, event_type string, n bigint, batch int").option("basePath", f"{target}/out").parquet(f"{target}/out")
    return written.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
