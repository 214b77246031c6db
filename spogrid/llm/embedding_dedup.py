"""Near-duplicate embeddings: all pairs of one label by tiles of int8 products.

Plan. Equal vectors of a label are one class (aggregated before the shuffle).
The classes of a label are dealt into blocks of about ``block`` by the hash of
their id, and every pair of blocks is a tile: one group of at most two blocks,
whatever the size of the label. In a tile the unit vectors are quantised to
int8, each with its own scale; the product of the integers is exact, and the
distance between a vector and its quantised form bounds the error:

    |u.v - u'.v'| <= |u - u'| + (1 + |u - u'|) |v - v'|

Only pairs whose bound reaches the threshold are computed again in double
precision. A tile returns counts for its vectors and the edges of a spanning
forest of its links, so what leaves a tile grows with its vectors and not
with its pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or a
non-finite number, and rows with a null label, link with nothing and are
kept; so do rows with a null id, which have no component; rows of one id are vectors of their own, each with its own links; repeated rows link with each other; vectors of different lengths never
link; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.llm.components import connected, roots, runs
from spogrid.llm.shared import bounded_batches, stored

BLOCK = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 form, its scale, and the length of the difference (rounded up)."""
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-12) + 1e-14
    return unit, q, scale, error


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= threshold in double precision."""
    (_, qa, sa, ea), (_, qb, sb, eb) = quantise(left), quantise(right)
    kind = np.float32 if left.shape[1] * 127**2 < 1 << 24 else np.float64  # sums of products of int8 are exact there
    approx = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb
    bound = ea[:, None] + (1 + ea[:, None]) * eb
    i, j = np.nonzero(approx + bound + 1e-9 >= threshold)
    na, nb = np.sqrt((left**2).sum(1)), np.sqrt((right**2).sum(1))
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = np.einsum("ij,ij->i", left[a], right[b]) / (na[a] * nb[b]) >= threshold
    return i[keep], j[keep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, class_id) for every row."""
    spark = vectors.sparkSession
    bounded_batches(vectors)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    limit = F.lit(float("inf"))
    whole = F.forall("v", lambda x: F.coalesce((x < limit) & (x > -limit), F.lit(False)))  # NaN is above all numbers
    valid = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull() & whole & F.exists("v", lambda x: x != 0))
    classes = valid.groupBy("label", F.size("v").alias("width"), "v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", "width").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = classes.join(sizes, ["label", "width"])
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("class"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("label", "width", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), "home", "class", "size", "v")
    keys = ["label", "width", "lo", "hi"]
    tiles = tiles.repartition(partitions, *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, keys):
            x, ids, n = _matrix(tile["v"]), tile["class"].to_numpy(), tile["size"].to_numpy()
            home, lo, hi = tile["home"].to_numpy(), tile["lo"][0].as_py(), tile["hi"][0].as_py()
            a, b = np.flatnonzero(home == lo), np.flatnonzero(home == hi)
            i, j = tile_links(x[a], x[b], threshold)
            i, j = a[i], b[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            root = ids[order][roots(len(ids), place[i], place[j])][place]
            some = np.flatnonzero(count)
            if len(some):
                yield pa.record_batch([pa.array(ids[some]), pa.array(root[some]), pa.array(count[some])], ["id", "root", "n"])

    found = stored(tiles.mapInArrow(compare, "id long, root long, n long"), "vector-links")
    parts = stored(connected(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "vector-groups")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    linked = stored(classes.select(F.col("class").alias("id"), "class_id").join(parts, "id").join(counts, "id"), "vector-linked")
    heads = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = linked.join(heads, "component").select(F.col("id").alias("class"), "component_id", "n")
    known = classes.join(linked, "class", "left")
    known = stored(
        known.select("label", "v", "class_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id")),
        "vector-results",
    )
    known = known.withColumnRenamed("label", "known_label").withColumnRenamed("v", "known_v")
    out = rows.join(known, F.col("vec_id").isNotNull() & (F.col("label") == F.col("known_label")) & (F.col("v") == F.col("known_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.coalesce("class_id", "vec_id").alias("class_id"),
    )
