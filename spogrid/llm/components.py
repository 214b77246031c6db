"""Connected components of an edge table, and runs of equal keys in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import stored


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of (a, b): the smallest id that can be reached.

    Large-star and small-star steps in turn, until the edges stay the same. Minima are
    aggregated before the shuffle and written, so that the joins on a much
    linked id read two plain tables and can be split. The number of rounds
    grows with the logarithm of the longest way. An empty table gives no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while (now := e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()) != seen:
        seen = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "lowest")
        large = stored(both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of the rows that follow each other with the same keys (integers)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if cut < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number linked to each of 0..n-1, directly or over others."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root
