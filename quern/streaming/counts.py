"""Structured streaming over file sources.

The batch operators work unchanged on streams; what is here adds sources, stateful
aggregates, and a sink that keeps a table of monotonic aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_a_batch: int = 1, **options) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(maxFilesPerTrigger=files_a_batch, **options).load(folder)


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys; rows later than `late` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is now into a memory table, and return that table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give every micro-batch to a function, once each by its number, restarting from the checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
