"""Run-log analytics over the events table (one run per day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.operators import metrics as M

QUERIES = ["click", "error", "purchase", "signup", "view"]


def _log(tables) -> DataFrame:
    return M.run_log(tables.events)


def run_metrics(tables):
    return M.run_metrics(_log(tables))


def mix_metrics(tables):
    return M.mix_metrics(_log(tables))


def merge_metrics(tables):
    return M.merge_metrics(M.partial_metrics(_log(tables)))


def steady_state(tables):
    return M.steady_state(_log(tables), n=5, bound=0.5)


def metrics_pivot(tables):
    return M.metrics_pivot(_log(tables), QUERIES)


def window_28d(tables):
    return M.window_counts(_log(tables), "2024-01-01", 28)


def mix_lookup(tables):
    ev = tables.events.select((F.col("event_id") % len(M.EXPLORE_MIX)).cast("int").alias("position"))
    looked = M.mix_lookup(tables.spark, ev)
    return looked.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
