"""Tables written to the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spogrid.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: the lineage is cut, and lost executors cost nothing that was done before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a few numbers each up to which a table is broadcast (some 10 MB).
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast where its counted rows are few; else joins shuffle it. For stored tables."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


# Bytes of an Arrow batch between Spark and Python; Spark's own default is 64 MB, of which each task holds several.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, SPARK_BATCH_BYTES = "4m", "67108864b"


def bounded_batches(df: DataFrame) -> None:
    """Small Arrow batches in this session, unless it has a size of its own: a task's memory then
    does not grow with the length of its texts."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == SPARK_BATCH_BYTES:
        conf.set(BATCH, BATCH_BYTES)
