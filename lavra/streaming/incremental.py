"""Incremental runs over a folder that grows, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import is_low_quality


def run_new_files(spark: SparkSession, folder: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], pattern: str = "*.parquet") -> None:
    """Calls ``work`` with the rows of files not seen by an earlier run of the same checkpoint, then ends."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def gate_stream(texts: DataFrame, text: str) -> DataFrame:
    """A stream (or table) without texts of low quality."""
    return texts.where(~is_low_quality(F.col(text)))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, kind, n): events by window and kind; on a stream, rows later than ``late`` are dropped."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
