"""Resumable logs as streams: new attempts are deduplicated by key and appended in atomic micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def attempts(spark: SparkSession, folder: str, schema) -> DataFrame:
    """JSON lines of attempts as they arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def ingest(stream: DataFrame, keys: list[str], time: str, late: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each key's first successful attempt once, as far as repeats are at most ``late`` apart. Runs until all
    that is there has been read; a restart with the same checkpoint goes on where it stopped."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, size: str, slide: str, late: str) -> DataFrame:
    """Rows per sliding window and kind; windows close when the watermark passes them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide), by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after a gap without rows."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
