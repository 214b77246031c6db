"""Session helpers: build a local session for tests, read cluster settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; the cluster's own values win where set.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # runtime bloom filters act as a dynamic semi-join reduction
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench.  A session that runs already is returned as it
    is, and without ``master`` only settings that the cluster leaves open are made."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("spogrid")
    given = SparkConf()
    settings = dict(_DEFAULTS)
    if master:
        builder = builder.master(master)
        settings |= {
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("SPOGRID_DRIVER_MEM", "16g"),
        }
    for k, v in settings.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A local session (tests) without the setting gets a temporary folder, which
    goes when Python ends.  On a cluster it is an error: a folder of one
    machine is not seen by the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spogrid-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/spogrid-tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it
    back: later consumers share the result and the lineage is cut (this
    survives executor loss, unlike a cache)."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove what this session has written under the shared folder; no DataFrame over it is usable after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/spogrid-tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
