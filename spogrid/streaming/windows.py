"""Event-time streams: windows under a watermark, and joins of two streams within an interval.

State is bounded by the watermarks: a window goes when its end is behind it, a row of a joined
stream when no row to come can match it. Rows behind the watermark are dropped; how many there were
is the difference to what arrived.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(at: str, size: str) -> Column:
    return F.window(at, size)


def sliding(at: str, size: str, step: str) -> Column:
    return F.window(at, size, step)


def session(at: str, gap: str) -> Column:
    return F.session_window(at, gap)


def windowed(events: DataFrame, at: str, delay: str, window: Column, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of each window and key, for a stream or a batch; a batch has no late rows."""
    if events.isStreaming:
        events = events.withWatermark(at, delay)
    out = events.groupBy(window.alias("window"), *keys).agg(*[c.alias(k) for k, c in aggs.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, delay: str, within: str) -> DataFrame:
    """Pairs of one key whose right row comes at most ``within`` after the left one. Both sides' columns, which must differ but for the key."""
    if left.isStreaming:
        left, right = left.withWatermark(left_at, delay), right.withWatermark(right_at, delay)
    near = (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}"))
    right = right.withColumnRenamed(key, "__key")
    return left.join(right, (F.col(key) == F.col("__key")) & near).drop("__key")


def files_in_order(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the files of a folder, one a batch, in the order in which they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_end(stream: DataFrame, out: str, checkpoint: str):
    """Append the stream's results as Parquet until its input is used up; returns the finished query."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q
