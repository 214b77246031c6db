"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Tokens are runs of word bytes and runs of other bytes that are not white space,
A-Z lower-cased; each falls into one of ``cells`` by its hash. Random indexing
gives every cell a fixed sparse vector of +1 and -1; a cell's word vector is
the sum of those of its neighbours (two on either side) in the sample, taken
to length one, less the mean of all, and again taken to length one. A document is the mean of its tokens' vectors, with a few pooled numbers
(share of tokens that repeat the one before, length, share of unknown cells, length of the
mean). A two-layer network in numpy learns labels from these, and a temperature
fitted on rows that it has not seen calibrates its probabilities.

The fit takes at most ``fit_rows`` labelled rows, those of the smallest hash of
their id; their texts stay on the executors, which return pooled vectors of fixed length. Word vectors and network have a
fixed size. Scoring reads every document whole.

Defined cases: a null or empty text pools to zeros and is scored as such; without
labelled rows every score is 0.5, with one class alone its smoothed share; rows
with the same id are scored each; an empty table gives no rows; columns other
than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import bounded_batches, stored
from spogrid.llm.textkit import LOWER, SOLID, WORD, byte_view, chunks, kept, word_hashes, word_spans

CELLS, WIDTH, SLOT = 1 << 14, 48, 256
FIT_ROWS = 20_000
HIDDEN, EPOCHS, RATE = 64, 60, 6e-3
CHUNK = 1 << 17
SEED = 7
_MARK = SOLID & ~WORD


class QualityModel(NamedTuple):
    vectors: np.ndarray  # cell x width, length one or zero
    mean: np.ndarray
    spread: np.ndarray
    weights: tuple[np.ndarray, ...]
    temperature: float
    constant: float | None = None  # score of every text when there was nothing to learn


def index_vectors(cells: int = CELLS, width: int = WIDTH) -> np.ndarray:
    """Sparse random vectors: three places +1 and three -1 of each cell."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((cells, width), np.float32)
    place = rng.random((cells, width)).argsort(1)[:, :6]
    np.put_along_axis(out, place, np.array([1, 1, 1, -1, -1, -1], np.float32), 1)
    return out


def token_cells(texts: pa.Array, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cell and text number of all tokens, in order."""
    data, off = byte_view(texts)
    data = LOWER[data]
    a, b, doc = word_spans(data, off, WORD)
    c, d, other = word_spans(data, off, _MARK)
    order = np.argsort(np.concatenate([a, c]), kind="stable")
    starts, ends = np.concatenate([a, c])[order], np.concatenate([b, d])[order]
    return (word_hashes(data, starts, ends) % np.uint64(cells)).astype(np.int64), np.concatenate([doc, other])[order]


def context_sums(cell: np.ndarray, doc: np.ndarray, index: np.ndarray) -> np.ndarray:
    """cell x (width + 1): index vectors of the neighbours of every occurrence, and the occurrences."""
    out = np.zeros((len(index), index.shape[1] + 1), np.float32)
    if not len(cell):
        return out
    own = index[cell]
    near = np.zeros_like(own)
    for k in (1, 2):
        same = (doc[k:] == doc[:-k])[:, None]
        near[k:] += own[:-k] * same
        near[:-k] += own[k:] * same
    order = np.argsort(cell, kind="stable")
    seen, first, n = np.unique(cell[order], return_index=True, return_counts=True)
    out[seen, :-1] = np.add.reduceat(near[order], first, axis=0)
    out[seen, -1] = n
    return out


def pool(cell: np.ndarray, doc: np.ndarray, n_docs: int, vectors: np.ndarray) -> np.ndarray:
    """document x (width + 4)."""
    out = np.zeros((n_docs, vectors.shape[1] + 4), np.float32)
    if not len(cell):
        return out
    docs, first, n = np.unique(doc, return_index=True, return_counts=True)
    own = vectors[cell]
    mean = np.add.reduceat(own, first, axis=0) / n[:, None]
    again = np.zeros(len(cell))
    again[1:] = (cell[1:] == cell[:-1]) & (doc[1:] == doc[:-1])
    unknown = ~vectors.any(1)
    out[docs] = np.column_stack([
        mean, np.add.reduceat(again, first) / n, np.log1p(n) / 10, np.add.reduceat(unknown[cell].astype(float), first) / n, np.sqrt((mean**2).sum(1)),
    ])
    return out


def _forward(x: np.ndarray, weights) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = weights
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, (hidden @ w2 + b2)[:, 0]


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Numbers far outside the sample's range, as in a text of one word, are taken to its rim."""
    return np.clip((x - mean) / spread, -10, 10)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights of the two layers, by Adam on mini-batches of the logistic loss."""
    rng = np.random.default_rng(SEED)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            part = order[at : at + 256]
            hidden, z = _forward(x[part], w)
            slope = ((_sigmoid(z) - y[part]) / len(part))[:, None]
            back = slope @ w[2].T * (hidden > 0)
            grads = [x[part].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ slope + 1e-4 * w[2], slope.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least logistic loss."""
    loss = lambda t: np.logaddexp(0, np.where(y > 0, -z, z) / t).sum()
    return float(min(np.exp(np.linspace(-1.5, 2.5, 161)), key=loss)) if len(y) else 1.0


def _word_vectors(sample: DataFrame) -> np.ndarray:
    """Context sums of the sample, added up by runs of cells, taken to length one."""

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((CELLS, WIDTH + 1))
        for batch in batches:
            for _, texts in chunks(batch, "text", CHUNK):
                total += context_sums(*token_cells(texts), index)
        for k in range(0, CELLS, SLOT):
            if total[k : k + SLOT].any():
                yield pa.record_batch([pa.array([k]), pa.array([total[k : k + SLOT].tobytes()])], ["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw)
        for k, sums in total.items():
            yield pa.record_batch([pa.array([k]), pa.array([sums.tobytes()])], ["slot", "sums"])

    schema = "slot long, sums binary"
    rows = sample.select("text").mapInArrow(part_sums, schema).repartition(8, "slot").mapInArrow(add, schema).collect()
    sums = np.zeros((CELLS, WIDTH + 1))
    for k, raw in rows:
        sums[k : k + SLOT] = np.frombuffer(raw).reshape(SLOT, WIDTH + 1)
    return word_vectors(sums[:, :-1], sums[:, -1])


def word_vectors(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    unit = lambda v: v / np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-9)
    vectors, known = unit(sums), sums.any(1)
    mean = n @ vectors / max(n.sum(), 1)
    return np.where(known[:, None], unit(vectors - mean), 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> QualityModel:
    """Learn word vectors from all documents that are usable, and the network from at most ``fit_rows`` labelled ones.

    An id whose labels differ teaches nothing; of several documents with one id, that with the smallest digest of its text does.
    """
    bounded_batches(docs)
    chosen = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    one = F.min_by(F.struct("text"), F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull())).alias("one")
    sample = stored(rows.groupBy("id", "y").agg(one).select("id", "y", "one.text"), "quality-sample")
    vectors = _word_vectors(docs.where(usable).select(F.col(text_col).cast("string").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                x = pool(*token_cells(texts), len(texts), shared.value)
                yield pa.record_batch([part.column("id"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    found = sample.select("id", "y", "text").mapInArrow(pooled, "id long, y int, x binary").orderBy("id").collect()
    y = np.array([r["y"] for r in found], float)
    if len(set(y.tolist())) < 2:
        share = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
        return QualityModel(vectors, np.zeros(0), np.zeros(0), (), 1.0, share)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], float)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = standard(x, mean, spread)
    apart = np.arange(len(x)) % 5 == 0  # rows that only calibrate
    weights = train(x[~apart], y[~apart])
    return QualityModel(vectors, mean, spread, weights, calibrate(_forward(x[apart], weights)[1], y[apart]))


def score_texts(texts: pa.Array, model: QualityModel) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = standard(pool(*token_cells(texts), len(texts), model.vectors), model.mean, model.spread)
    return _sigmoid(_forward(x, model.weights)[1] / model.temperature)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                p = score_texts(texts, shared.value)
                yield pa.record_batch([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents of that score or a better one, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept(docs, text_col, lambda: lambda texts: score_texts(texts, shared.value) >= threshold, CHUNK)
