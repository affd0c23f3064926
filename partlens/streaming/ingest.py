"""Structured Streaming over folders of Parquet files.

Files are read once, by the stream's checkpoint. Rows that repeat an id within the watermark are dropped by the stream's state;
a batch is written under its number, so one that runs again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How long after an event its repeat may still come.
DELAY = "2 days"


def arriving(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet", files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)


def once(rows: DataFrame, key: str, time: str, delay: str = DELAY) -> DataFrame:
    """Rows of a stream, the first of each key within the delay; the state holds the keys of that span only."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, width: str, *keys: str, delay: str = DELAY) -> DataFrame:
    """Counts by event-time window; a window is final once the watermark has passed it."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))


def drain(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Handle all files that are there, batch by batch, and stop; called again it goes on after the last."""
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch under its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
