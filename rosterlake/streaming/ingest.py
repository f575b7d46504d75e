"""Imports as a stream: files of records arrive in a folder and become rows of the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterlake.sources import pool as source


def arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(file_name, body, arrived_at) of JSON files as they come, each a bare array or an object with key candidates."""
    read = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger)
    named = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return read.load(folder).select(named.alias("file_name"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("arrived_at"))


def imported(bodies: DataFrame, imported_at: int) -> DataFrame:
    """The rows of the pool that streamed bodies bring."""
    return source.ingest(source.unpack(bodies, "file_name", "body"), ["file_name", "record_no"], "record", imported_at)


def start(bodies: DataFrame, pool_path: str, checkpoint: str, imported_at: int, once: bool = True) -> StreamingQuery:
    """Append what arrives to the pool. A batch that is run again after a failure writes its own folder again, so no row comes twice."""

    def append(batch: DataFrame, number: int) -> None:
        imported(batch, imported_at).write.mode("overwrite").parquet(f"{pool_path}/batch={number}")

    writer = bodies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen(findings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first of each (kind, fingerprint) within the watermark, of streamed findings with ``arrived_at``."""
    return findings.withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["kind", "fingerprint"])


def feed_counts(requests: DataFrame, lateness: str = "7 days", window: str = "1 day") -> DataFrame:
    """(window, feed, n_files, n_records) of streamed import requests by when they were received; late ones count while the watermark allows."""
    seen = requests.withWatermark("received_at", lateness)
    return seen.groupBy(F.window("received_at", window), "feed").agg(F.count("*").alias("n_files"), F.sum("n_records").alias("n_records"))
