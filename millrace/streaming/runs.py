"""Streams of run records and chunks: incremental latest attempts, first-wins de-duplication and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.operators.matrix import latest


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; a key is remembered for ``delay`` of event time, so state is bounded."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def status_counts(stream: DataFrame, event_time: str, by: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), by).agg(F.count("*").alias("n"))


def merge_latest(stream: DataFrame, path: str, key: list[str], attempt: str, order: str) -> DataStreamWriter:
    """Keep a table of latest attempts: each batch is merged with what is there and written to the other of two folders.

    A batch that is run again after a failure gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, new = f"{path}/{'ab'[number % 2]}", f"{path}/{'ab'[(number + 1) % 2]}"
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        latest(rows, key, attempt, order).write.mode("overwrite").parquet(new)

    return stream.writeStream.foreachBatch(merge).outputMode("append")
