"""Approximate nearest neighbours by inner product: multi-index hashing over learned binary codes.

Plan. (1) Vectors get a further component that makes them equally long within a band of
similar lengths, so that the largest inner product is the smallest angle. (2) Rotations
learned on a bounded sample (iterative quantisation; several, stacked, where the
vectors are shorter than the code) turn each vector into ``BITS`` signs. (3) Queries are
dealt into blocks and rows into a fixed number of stripes by hash; a task holds one block of queries and reads the rows
of one stripe piece by piece. In a piece every substring of the
codes is indexed by its value, and a query probes the values near its own: a
code within Hamming distance r of the query has a substring within
r div (substrings), so probing to there and comparing whole codes retrieves every code
within r. Where the probes would touch more entries than there are codes, all codes are compared.
(4) The radius follows from the k-th best product that the task has for the query so far: it is
the distance within which the sample's neighbours at that product's angle fall (their ``RECALL`` quantile);
a query without k rows yet takes every code. What is
retrieved is ranked by the inner product of the vectors themselves, summed
in double precision from the first component to the last.

A task holds a block of queries with k rows each and one piece of rows, and returns k rows a query; the
stripes' best are merged. Hot vectors need no care, as stripes go by a hash of the row.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and
rows without an id, take no part; vectors meet those of their own length only; of
repeated ids each row is a query and a candidate of its own, and only the row itself is no candidate of its query;
equal products go by the smaller vec_id; a query with fewer candidates
than k has them all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spogrid.llm.shared import bounded_batches, stored
from spogrid.llm.textkit import ragged

BITS, PART = 256, 16
PARTS = BITS // PART
# Rows of each vector length that the rotations are learned on, and rounds of learning.
FIT_ROWS, ROUNDS = 4096, 30
# Share of the sample's neighbours that a radius holds.
RECALL = 0.995
# Bytes of the vectors of a block of queries, and stripes of rows.
BLOCK_BYTES, STRIPES = 2 << 20, 8
# Pairs of a query and a code looked at together.
PIECE = 1 << 20
# Substring values by their distance from 0, and how many are within each distance.
MASKS = np.array([sum(1 << b for b in bits) for r in range(PART + 1) for bits in combinations(range(PART), r)], np.uint16)
WITHIN = np.cumsum(np.bincount(np.bitwise_count(MASKS), minlength=PART + 1))


@dataclass
class Model:
    """Projection (components and one more, by bits) and the spread of neighbours' distances."""

    project: np.ndarray
    slack: float


def extended(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows over ``longest``, with the component that makes them unit vectors."""
    unit = x / longest
    return np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))])


def asked(x: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, without a further component."""
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return np.column_stack([x / np.sqrt((x**2).sum(1, keepdims=True)), np.zeros(len(x))])


def codes(x: np.ndarray, project: np.ndarray) -> np.ndarray:
    return np.packbits(x @ project > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of codes (rows of 64-bit words) that stand side by side."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint16)
    for w in range(a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def spread(angle: np.ndarray) -> np.ndarray:
    """Standard deviation of the distance at an angle, if bits were independent."""
    p = angle / np.pi
    return np.sqrt(BITS * p * (1 - p)) + 0.5


def learn(sample: np.ndarray, longest: float, seed: int = 7) -> Model:
    """Rotations by iterative quantisation, without centring, so that the share of differing bits follows the angle."""
    rng = np.random.default_rng(seed)
    x = extended(sample, longest)
    base = np.eye(x.shape[1])
    if x.shape[1] > BITS:
        base = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
    stack = []
    while sum(r.shape[1] for r in stack) < BITS:
        y = x @ base
        rot = np.linalg.qr(rng.standard_normal((base.shape[1], base.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(y.T @ np.where(y @ rot > 0, 1.0, -1.0))
            rot = u @ v
        stack.append(base @ rot)
    project = np.column_stack(stack)[:, :BITS]
    # distances of the nearest sample rows to some of them, beside those that independent bits would have
    q = asked(sample[:512])
    near = np.clip(q @ x.T, -1, 1)
    near[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argsort(-near, axis=1)[:, : min(20, len(x) - 1)]
    angle = np.arccos(np.take_along_axis(near, top, 1))
    far = hamming(codes(q, project).view(np.uint64)[:, None], codes(x, project).view(np.uint64)[top])
    off = (far - BITS * angle / np.pi) / spread(angle)
    return Model(project, max(2.0, float(np.quantile(off, RECALL))) if off.size >= 200 else 4.0)


def radius(model: Model, bound: np.ndarray, longest: float) -> np.ndarray:
    """Distance within which codes at the bound's angle fall; -1 where no row can reach the bound.

    ``bound`` is the product over the query's length, ``longest`` that of the longest row.
    """
    cos = bound / longest
    angle = np.arccos(np.clip(cos, -1, 1))
    r = np.ceil(BITS * angle / np.pi + model.slack * spread(angle))
    return np.where(cos > 1 + 1e-9, -1, np.clip(np.nan_to_num(r, nan=BITS), 0, BITS)).astype(np.int64)


class SubstringIndex:
    """Codes by the value of each of their substrings."""

    def __init__(self, code: np.ndarray):
        self.words, self.n = code.view(np.uint64), len(code)
        parts = code.view(np.uint16)
        self.order = np.concatenate([np.argsort(parts[:, j], kind="stable") for j in range(PARTS)])
        # where the entries of a value begin, for all substrings one after the other
        counts = [np.concatenate([[0], np.cumsum(np.bincount(parts[:, j], minlength=1 << PART))]) + j * self.n for j in range(PARTS)]
        self.start = np.stack(counts)

    def within(self, query: np.ndarray, r: int) -> np.ndarray:
        """For each query and code: whether they are within distance r."""
        reach = min(r // PARTS, PART)
        if int(WITHIN[reach]) * PARTS >= 1 << PART:  # the probes would touch more entries than there are codes
            return hamming(query.view(np.uint64)[:, None], self.words[None]) <= r
        mark = self.probed(query, reach)
        q, x = np.nonzero(mark)
        mark[q, x] = hamming(query.view(np.uint64)[q], self.words[x]) <= r
        return mark

    def probed(self, query: np.ndarray, reach: int) -> np.ndarray:
        """For each query and code: whether some substring of theirs is within ``reach``."""
        probes = query.view(np.uint16)[:, :, None] ^ MASKS[: WITHIN[reach]]
        j = np.arange(PARTS)[:, None]
        first, end = self.start[j, probes].ravel(), self.start[j, probes.astype(np.int64) + 1].ravel()
        hit = np.repeat(np.repeat(np.arange(len(query)), probes.shape[1] * probes.shape[2]), end - first)
        mark = np.zeros((len(query), self.n), bool)
        mark[hit, self.order[ragged(first, end - first)]] = True
        return mark


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b, summed from the first component to the last."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 16):
        p, q = a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]]
        total = out[at : at + (1 << 16)]
        for k in range(a.shape[1]):
            total += p[:, k] * q[:, k]
    return out


class Best:
    """The k best rows of each query so far, best first: product, vec_id, row."""

    def __init__(self, query: np.ndarray, code: np.ndarray, row: np.ndarray, k: int):
        self.query, self.code, self.row, self.k = query, np.ascontiguousarray(code), row, k
        self.length = np.sqrt((query**2).sum(1))
        self.found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.least = np.full(len(query), -np.inf)

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        i, score, ids, row = (np.concatenate(x) for x in zip(self.found, (i, score, ids, row), strict=True))
        order = np.lexsort((row, ids, -score, i))
        i, score, ids, row = i[order], score[order], ids[order], row[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.k - 1
        self.least[i[last]] = score[last]
        best = place < self.k
        self.found = [i[best], score[best], ids[best], row[best]]

    def search(self, x: np.ndarray, code: np.ndarray, ids: np.ndarray, row: np.ndarray, reach: np.ndarray) -> None:
        """Take in the rows within each query's reach."""
        index = SubstringIndex(code)
        step = max(1, PIECE // index.n)
        # what two orders of summation can differ by, at most
        margin = 4 * x.shape[1] * np.finfo(float).eps * self.length * np.sqrt((x**2).sum(1).max())
        new = []
        for r in np.unique(reach[reach >= 0]):
            members = np.flatnonzero(reach == r)
            for at in range(0, len(members), step):
                group = members[at : at + step]
                near = index.within(self.code[group], int(r))
                near &= self.row[group][:, None] != row
                # a matrix product tells which rows can be among the best; only these are summed in order
                about = np.where(near, self.query[group] @ x.T, -np.inf)
                floor = (self.least - margin)[group]
                if index.n > self.k:
                    kth = np.partition(about, index.n - self.k, axis=1)[:, index.n - self.k]
                    floor = np.fmax(floor, kth - 2 * margin[group])
                i, j = np.nonzero(near & ~(about < floor[:, None]))
                new.append((group[i], products(self.query, x, group[i], j), ids[j], row[j]))
        if new:
            self.add(*(np.concatenate(c) for c in zip(*new, strict=True)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where a key changes."""
    for batch in batches:
        change = np.zeros(batch.num_rows, bool)
        for name in keys:
            c = batch.column(name).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def prepared(vectors: DataFrame, every: int, id_col: str, vector_col: str) -> DataFrame:
    """The rows that take part: (row, vec_id, width, band, length, asks, v)."""
    v, limit = F.col(vector_col), F.lit(float("inf"))
    finite = F.forall("v", lambda x: F.coalesce((x < limit) & (x > -limit), F.lit(False)))  # NaN is above all numbers
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    rows = rows.withColumn("top", top)
    length = F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.col("top"), F.lit(2))))
    rows = rows.withColumn("length", length).withColumn("band", F.floor(F.log2("length") + 0.5).cast("int"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("width"), "band", "length", (F.col("vec_id") % every == 0).alias("asks"), "v")
    return stored(rows, "search-rows")


def fit(rows: DataFrame, layout: list) -> dict[int, Model]:
    """A model for each vector length, from about ``FIT_ROWS`` rows of it."""
    counts: dict[int, int] = {}
    longest: dict[int, float] = {}
    for r in layout:
        counts[r["width"]] = counts.get(r["width"], 0) + r["n"]
        longest[r["width"]] = max(longest.get(r["width"], 0.0), r["longest"])
    out = {}
    for width, n in counts.items():
        share = 1 << 30 if n <= FIT_ROWS else (FIT_ROWS << 30) // n
        picked = rows.where((F.col("width") == width) & (F.pmod(F.xxhash64("row", "vec_id"), F.lit(1 << 30)) < share)).select("v").limit(2 * FIT_ROWS)
        sample = np.array([r["v"] for r in picked.collect()], np.float64).reshape(-1, width)
        out[width] = learn(sample, longest[width]) if len(sample) else Model(np.eye(width + 1, BITS), 4.0)
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides, the k rows of largest inner product that were found."""
    spark = vectors.sparkSession
    bounded_batches(vectors)
    rows = prepared(vectors, every, id_col, vector_col)
    layout = rows.groupBy("width", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.max("length").alias("longest")).collect()
    models = fit(rows, layout)
    longest = {(r["width"], r["band"]): r["longest"] * (1 + 1e-12) for r in layout}
    asks = {w: sum(r["asks"] for r in layout if r["width"] == w) for w in models}
    blocks = [(w, -(-n // max(64, block_bytes // (8 * w)))) for w, n in asks.items()]
    # one row for each length of vectors
    deal = F.broadcast(spark.createDataFrame(blocks, "width int, blocks long"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, STRIPES * sum(n for _, n in blocks)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, band = (batch.column(c).to_numpy() for c in ("width", "band"))
            code, ask = np.zeros((len(width), BITS // 8), np.uint8), np.zeros((len(width), BITS // 8), np.uint8)
            for w, b in sorted(set(zip(width.tolist(), band.tolist(), strict=True))):
                at = np.flatnonzero((width == w) & (band == b))
                x = _matrix(batch.column("v").take(pa.array(at)))
                code[at] = codes(extended(x, longest[w, b]), models[w].project)
                ask[at] = codes(asked(x), models[w].project)
            both = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(width), [None, pa.py_buffer(c.tobytes())]).cast(pa.binary()) for c in (code, ask)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], [*batch.schema.names, "code", "ask_code"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    index = stored(rows.mapInArrow(encode, f"{fields}, code binary, ask_code binary"), "search-codes")
    keys, lead = ["width", "block", "stripe"], F.sequence(F.lit(0), F.lit(STRIPES - 1))
    tail = ["row", "vec_id", "length", "code", "v"]
    dealt = index.join(deal, "width").where("blocks > 0")
    held = dealt.withColumn("stripe", F.pmod(F.xxhash64("row"), F.lit(STRIPES)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = held.select(*keys, F.lit(1).alias("part"), "band", *tail)
    queries = dealt.where("asks").withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks"))).withColumn("stripe", F.explode(lead))
    queries = queries.select(*keys, F.lit(0).alias("part"), F.lit(0).alias("band"), "row", "vec_id", "length", F.col("ask_code").alias("code"), "v")
    # queries first, then rows from the longest on
    work = held.unionByName(queries).repartition(tasks, *keys).sortWithinPartitions(*keys, "part", F.desc("band"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, ids = None, None, []

        def close() -> pa.RecordBatch:
            i, score, vec_id, row = best.found
            return pa.record_batch([pa.array(c) for c in (best.row[i], ids[i], row, vec_id, score)], ["query_row", "query_id", "row", "vec_id", "score"])

        for part in pieces(batches, [*keys, "part", "band"]):
            width, band, key = part["width"][0].as_py(), part["band"][0].as_py(), tuple(part[c][0].as_py() for c in keys)
            x, row, own = _matrix(part["v"]), part["row"].to_numpy(), part["vec_id"].to_numpy()
            code = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(len(row), -1)
            if not part["part"][0].as_py():
                if at == key:  # more of the block's queries
                    best = Best(np.vstack([best.query, x]), np.vstack([best.code, code]), np.concatenate([best.row, row]), k)
                    ids = np.concatenate([ids, own])
                else:
                    if best is not None:
                        yield close()
                    at, best, ids = key, Best(x, code, row, k), own
            elif at == key:
                far = radius(models[width], best.least / best.length, longest[width, band])
                best.search(x, code, own, row, np.where(np.isinf(best.least), BITS, far))
        if best is not None:
            yield close()

    schema = "query_row long, query_id long, row long, vec_id long, score double"
    found = stored(work.mapInArrow(compare, schema), "search-found")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
