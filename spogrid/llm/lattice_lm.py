"""Document probability under a unigram subword model, summed over all segmentations.

Model. The pieces are those of an existing vocabulary (byte pieces included),
each with a probability, and one end-of-text event. The vocabulary's scores
give the first probabilities (one over the rank). A text is a sequence of
tokens and an end. No piece reaches over white space, so the lattice of a text
falls apart into the lattices of its tokens, and the marginal probability of a
token is one number: a forward recursion in logarithms over its bytes sums all
segmentations. Beside the ways through pieces, the lattice of a token has one
arc over the whole token, weighted by its share of the training tokens; all
whole-token arcs together have the weight that remains from the pieces'. Both
that weight and the pieces' probabilities are fitted by expectation-maximisation over
all training tokens, where each occurrence sees the counts of the others only.
Every distinct token is worked once for the whole corpus.

Plan. (1) Chunks of text become rows of distinct tokens by hash bucket with
their training counts, and one row of (document, token, count) triples each; both
are stored. (2) A task takes a bucket's tokens from all chunks and writes each
distinct one with its count. (3) Expectation-maximisation passes over these. (4)
Buckets answer every chunk's tokens with count and probability. (5) A chunk's answers
meet its triples and give the documents' sums. What a task holds is one
chunk, or the distinct tokens of its buckets; a frequent token is one entry
for each chunk.

Defined cases: a null or empty text, or one of white space, has the end alone;
with no training row the probabilities stay as the vocabulary's order has them;
rows with the same id each have a row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import bounded_batches, stored
from spogrid.llm.textkit import LOWER, SOLID, byte_view, chunks, distinct_spans, word_spans

CHUNK = 8 << 20
BUCKETS_PER_PARTITION = 4
EM_ROUNDS = 3
PRIOR_WEIGHT = 200.0  # counts that the vocabulary's own order is worth in a fit
SPACE = b"\x20"  # stands for the vocabulary's word mark; no token holds it
NEVER = -1e30
SEGMENT = 256  # bytes of a long token that are held at a time


class Pieces(NamedTuple):
    """The vocabulary: bytes of each piece one after the other, starts, and each piece's first probability; the end comes last."""

    flat: np.ndarray
    starts: np.ndarray
    first_p: np.ndarray

    @property
    def size(self) -> int:
        return len(self.starts) - 1


def load_pieces(model_file: str) -> Pieces:
    """Pieces of a sentencepiece model, with probabilities that fall as one over the rank."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found: dict[bytes, float] = {}
    for k in range(vocabulary.get_piece_size()):
        if vocabulary.is_control(k) or vocabulary.is_unknown(k) or vocabulary.is_unused(k):
            continue
        text = vocabulary.id_to_piece(k)
        if vocabulary.is_byte(k):
            found.setdefault(bytes([int(text[1:-1], 16)]), 1e-6)
        elif "▁" not in text[1:]:
            raw = text.replace("▁", " ").encode()
            found[raw] = max(found.get(raw, 0), 1 / (10 + max(0.0, -vocabulary.get_score(k))))
    order = sorted(found)
    p = np.array([found[x] for x in order] + [max(found.values())])
    return Pieces(np.frombuffer(b"".join(order), np.uint8), np.cumsum([0, *map(len, order)]), p / p.sum())


_BASE = np.uint64(0x2545F4914F6CDD1D)


class Lattice:
    """Forward (and backward) sums over the segmentations of tokens."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray):
        self.log_p = np.append(log_p[:-1], NEVER)  # of the pieces; the last for no piece
        self.end = float(log_p[-1])
        self.none = len(log_p) - 1  # as many as there are pieces
        lens = np.diff(pieces.starts)
        self.longest = int(lens.max())
        keys = np.zeros(len(lens), np.uint64)
        for k in range(self.longest):
            live = lens > k
            keys[live] = keys[live] * _BASE + pieces.flat[pieces.starts[:-1][live] + k] + np.uint64(1)
        keys = keys * np.uint64(64) + lens.astype(np.uint64)  # told apart by hash and length
        assert len(np.unique(keys)) == len(keys)
        # open table: every key lies in the first free cell of its probes
        self.bits, self.probes = 18, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, self.none, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            cell = self._cell(keys[todo], self.probes)
            _, one = np.unique(cell, return_index=True)
            one = one[self.ids[cell[one]] == self.none]
            self.keys[cell[one]], self.ids[cell[one]] = keys[todo[one]], todo[one]
            todo = np.delete(todo, one)
            self.probes += 1

    def _cell(self, keys: np.ndarray, probe: int) -> np.ndarray:
        spread = np.uint64([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93][probe % 4] + 2 * (probe // 4))
        return ((keys * spread) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, self.none, np.int32)
        for probe in range(self.probes):
            cell = self._cell(keys, probe)
            hit = self.keys[cell] == keys
            out[hit] = self.ids[cell][hit]
        return out

    def piece_ids(self, grid: np.ndarray) -> list[np.ndarray]:
        """grid: position x token bytes. Entry l - 1: position x token id of the piece of l bytes that ends there."""
        wide = len(grid)
        out, keys = [], np.zeros(grid.shape, np.uint64)
        power = 1
        for k in range(min(self.longest, wide)):
            # keys[e] covers bytes e - k .. e
            keys[k:] = (grid[: wide - k].astype(np.uint64) + np.uint64(1)) * np.uint64(power) + keys[k:]
            power = power * int(_BASE) % (1 << 64)
            ids = np.full(grid.shape, self.none, np.int32)
            ids[k:] = self.find(keys[k:] * np.uint64(64) + np.uint64(k + 1))
            out.append(ids)
        return out

    def forward(self, ids: list[np.ndarray]) -> np.ndarray:
        """alpha: position (0: before the first byte) x token."""
        wide, n = ids[0].shape
        alpha = np.full((wide + 1, n), NEVER)
        alpha[0] = 0
        for t in range(wide):
            reach = min(len(ids), t + 1)
            ways = np.stack([alpha[t - k] + self.log_p[ids[k][t]] for k in range(reach)])
            top = ways.max(0)
            alpha[t + 1] = np.maximum(top + np.log(np.exp(ways - top).sum(0)), NEVER)
        return alpha

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens of the same length together: their numbers, and position x token bytes, after the word mark."""
        lens = np.array([len(w) for w in words])
        order = np.argsort(lens, kind="stable")
        cut = np.flatnonzero(np.diff(lens[order])) + 1
        for same in np.split(order, cut):
            wide = int(lens[same[0]]) if len(same) else 0
            if not wide:
                continue
            step = max(1, (1 << 19) // (wide + 1))
            for at in range(0, len(same), step):
                part = same[at : at + step]
                raw = np.frombuffer(b"".join(SPACE + words[k] for k in part), np.uint8)
                yield part, raw.reshape(len(part), wide + 1).T

    def score(self, words: list[bytes], counts: np.ndarray, whole: float, n: int) -> np.ndarray:
        """Natural logarithm of each token's probability; the empty token is the end."""
        out = np.full(len(words), self.end)
        for part, grid in self.groups(words):
            out[part] = self._forward(grid)[-1]
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log1p(-whole) + out, np.log(whole * counts / max(n, 1)))

    def _forward(self, grid: np.ndarray) -> np.ndarray:
        if len(grid) <= SEGMENT:
            return self.forward(self.piece_ids(grid))
        # a very long token: the last sums carry on, so that what is held stays small
        alpha = self._before(grid.shape[1])
        for at in range(0, len(grid), SEGMENT):
            alpha = self._carried(grid, at, alpha)[-self.longest :]
        return alpha

    def _before(self, n: int) -> np.ndarray:
        """The sums at the start of n tokens, which is the last of the positions held."""
        alpha = np.full((self.longest, n), NEVER)
        alpha[-1] = 0
        return alpha

    def _carried(self, grid: np.ndarray, at: int, alpha: np.ndarray) -> np.ndarray:
        """The sums at the positions up to ``at``, and after them those of the segment's."""
        lo = max(0, at - self.longest + 1)
        ids = [x[at - lo :] for x in self.piece_ids(grid[lo : at + SEGMENT])]
        alpha = np.concatenate([alpha, np.full((len(ids[0]), grid.shape[1]), NEVER)])
        for t in range(len(ids[0])):
            reach, here = min(len(ids), at + t + 1, self.longest), self.longest + t
            ways = np.stack([alpha[here - 1 - k] + self.log_p[ids[k][t]] for k in range(reach)])
            top = ways.max(0)
            alpha[here] = np.maximum(top + np.log(np.exp(ways - top).sum(0)), NEVER)
        return alpha

    def expected(self, words: list[bytes], counts: np.ndarray, whole: float, n: int) -> np.ndarray:
        """Expected uses of each piece (then of none, the end, and occurrences read through pieces) in the tokens,
        each as often as its count. Long tokens are read by segments, forward sums kept at their borders."""
        total = np.zeros(self.none + 3)
        for part, grid in self.groups(words):
            wide, n_words = grid.shape
            borders = [self._before(n_words)]
            for at in range(0, wide, SEGMENT):
                last = self._carried(grid, at, borders[-1])
                borders.append(last[-self.longest :].copy())
            ends = borders[-1][-1]
            weight = counts[part] * self.share(ends, counts[part] - 1, whole, n)
            total[-1] += weight.sum()
            beta = np.full((self.longest, n_words), NEVER)
            beta[0] = 0
            for at in reversed(range(0, wide, SEGMENT)):
                size = min(SEGMENT, wide - at)
                alpha = (last if at + SEGMENT >= wide else self._carried(grid, at, borders[at // SEGMENT]))[self.longest - 1 :]
                ids = self.piece_ids(grid[at : at + size + self.longest - 1])
                beta = np.concatenate([np.full((size, n_words), NEVER), beta])
                for t in range(size - 1, -1, -1):
                    # all pieces that begin at t: of k + 1 bytes, ending at t + k
                    reach = min(len(ids), wide - at - t)
                    here = np.stack([ids[k][t + k] for k in range(reach)])
                    ways = np.stack([beta[t + k + 1] for k in range(reach)]) + self.log_p[here]
                    top = ways.max(0)
                    beta[t] = np.maximum(top + np.log(np.exp(ways - top).sum(0)), NEVER)
                    real = here != self.none
                    used = np.exp((ways + (alpha[t] - ends))[real]) * np.broadcast_to(weight, here.shape)[real]
                    total[: self.none] += np.bincount(here[real], used, self.none)
                beta = beta[: self.longest]
        for k in (k for k, w in enumerate(words) if not w):
            end = float(counts[k] * self.share(np.array(self.end), counts[k] - 1, whole, n))
            total[-2] += end
            total[-1] += end
        return total

    @staticmethod
    def share(log_pieces: np.ndarray, others: np.ndarray, whole: float, n: int) -> np.ndarray:
        """How far a token is read through pieces, given how often it occurs otherwise."""
        with np.errstate(divide="ignore", over="ignore"):  # in logarithms, as a long token's probability is no double
            return 1 / (1 + np.exp(np.log(whole * others / n) - np.log1p(-whole) - log_pieces))


def _pack(words: list[bytes]) -> bytes:
    return b"\n".join(words)


_WORDS = "kind int, chunk long, bucket int, words binary, counts binary, doc_ids array<long>, flags array<int>, sizes array<int>"
_NAMES = [x.split()[0] for x in _WORDS.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _row(*values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, _KINDS, strict=True)], _NAMES)


def tokens_by_bucket(docs: DataFrame, in_training: Column, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0: a chunk's distinct tokens of one bucket, in order, and their training counts.
    Rows of kind 1: a chunk's documents, and for each its tokens (numbered by bucket, then by the rows of kind 0)
    with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                chunk += 1
                data, off = byte_view(texts)
                data = LOWER[data]
                starts, ends, doc = word_spans(data, off, SOLID)
                n, n_docs = len(starts), len(texts)
                a, b, which = distinct_spans(data, starts, ends)
                # the end is a token of each document, with no bytes
                words = [data[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)] + [b""]
                which, doc = np.append(which, np.full(n_docs, len(words) - 1)), np.append(doc, np.arange(n_docs))
                home = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
                order = np.argsort(home, kind="stable")
                place = np.empty(len(words), np.int64)
                place[order] = np.arange(len(words))
                train = np.array(part.column("train").to_pylist(), bool)
                counts = np.bincount(which[train[doc]], minlength=len(words)).astype(np.int32)
                cut = np.searchsorted(home[order], np.arange(buckets + 1))
                for k in np.unique(home).tolist():
                    mine = order[cut[k] : cut[k + 1]]
                    yield _row(0, chunk, k, _pack([words[i] for i in mine]), counts[mine].tobytes(), None, None, None)
                pairs, times = np.unique(doc * len(words) + place[which], return_counts=True)
                sizes = np.bincount(pairs // len(words), minlength=n_docs)
                at = (pairs % len(words)).astype(np.int32)
                yield _row(1, chunk, buckets, at.tobytes(), times.astype(np.int32).tobytes(), part.column("doc_id").to_pylist(), train.astype(int).tolist(), sizes.tolist())

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(in_training, F.lit(False)).alias("train"))
    return rows.mapInArrow(run, _WORDS)


def _split(blob: bytes) -> list[bytes]:
    return blob.split(b"\n")


def vocabulary(token_rows: DataFrame, partitions: int) -> DataFrame:
    """(words, counts, n, v): every distinct token with its training count, in rows of bounded size,
    with the sum of the counts and the number of tokens with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        counts = np.zeros(1024, np.int64)
        for batch in batches:
            for blob, raw in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words = _split(blob)
                at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                if len(known) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(known), len(counts)), np.int64)])
                counts[at] += np.frombuffer(raw, np.int32)  # a word comes once in a row
        words, counts = list(known), counts[: len(known)]
        seen = np.flatnonzero(counts)  # tokens of no training text have no part in a fit
        for i in range(0, len(seen), 100_000):
            part = seen[i : i + 100_000]
            c = counts[part]
            yield pa.record_batch([pa.array([_pack([words[k] for k in part])]), pa.array([c.tobytes()]), pa.array([int(c.sum())]), pa.array([len(c)])], ["words", "counts", "n", "v"])

    return token_rows.repartition(partitions, "bucket").select("words", "counts").mapInArrow(run, "words binary, counts binary, n long, v long")


def fit(words: DataFrame, pieces: Pieces, rounds: int, n_tokens: int) -> tuple[np.ndarray, float]:
    """Logarithms of the pieces' probabilities, the end's last, and the weight of the whole-token arcs.
    Each round sends at most one number for each piece and task."""
    p, whole = pieces.first_p, 0.5 if n_tokens > 1 else 0.0
    for _ in range(rounds if n_tokens > 1 else 0):
        log_p = np.log(p)

        def expect(batches: Iterator[pa.RecordBatch], log_p=log_p, whole=whole) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces, log_p), np.zeros(len(log_p) + 2)
            for batch in batches:
                for blob, raw in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    total += lattice.expected(_split(blob), np.frombuffer(raw, np.int64).astype(float), whole, n_tokens - 1)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        found = words.select("words", "counts").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros(len(p) + 2)
        uses[found["piece"]] = found["uses"]
        whole = float(np.clip(1 - uses[-1] / n_tokens, 0.01, 0.99))
        p = np.append(uses[: pieces.size], uses[-2]) + PRIOR_WEIGHT * pieces.first_p
        p /= p.sum()
    return np.log(p), whole


def answers(token_rows: DataFrame, pieces: Pieces, log_p: np.ndarray, whole: float, n_tokens: int, partitions: int) -> DataFrame:
    """(chunk, bucket, counts, log_p) for every row of tokens, in the row's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, log_p)
        known: dict[bytes, int] = {}
        rows, total = [], np.zeros(1024, np.int64)
        for batch in batches:
            for chunk, bucket, blob, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "words", "counts")), strict=True):
                words = _split(blob)
                at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                if len(known) > len(total):
                    total = np.concatenate([total, np.zeros(max(len(known), len(total)), np.int64)])
                total[at] += np.frombuffer(raw, np.int32)
                rows.append((chunk, bucket, at))
        score = lattice.score(list(known), total[: len(known)], whole, n_tokens)
        for chunk, bucket, at in rows:
            yield pa.record_batch(
                [pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([total[at].astype(np.int64).tobytes()], pa.binary()), pa.array([score[at].astype(np.float32).tobytes()], pa.binary())],
                ["chunk", "bucket", "counts", "log_p"],
            )

    return token_rows.repartition(partitions, "bucket").select("chunk", "bucket", "words", "counts").mapInArrow(run, "chunk long, bucket int, counts binary, log_p binary")


def document_sums(answered: DataFrame, triples: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, sum_log10, score): a chunk's answers in order of bucket, then its documents."""
    empty = lambda kind: F.lit(None).cast(kind)
    left = answered.select("chunk", "bucket", F.col("counts").alias("x"), F.col("log_p").alias("y"), empty("array<long>").alias("doc_ids"), empty("array<int>").alias("flags"), empty("array<int>").alias("sizes"))
    right = triples.select("chunk", "bucket", F.col("words").alias("x"), F.col("counts").alias("y"), "doc_ids", "flags", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list = []
        scores: list = []
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, ids = (batch.column(c)[k].as_py() for c in ("x", "y", "doc_ids"))
                if ids is None:
                    counts.append(np.frombuffer(x, np.int64))
                    scores.append(np.frombuffer(y, np.float32))
                    continue
                c, s = np.concatenate(counts), np.concatenate(scores).astype(np.float64)
                at, times = np.frombuffer(x, np.int32), np.frombuffer(y, np.int32).astype(np.int64)
                sizes = np.array(batch.column("sizes")[k].as_py())
                first = np.cumsum(sizes) - sizes  # every document has its end
                sums = [np.add.reduceat(v, first) for v in (times, times * (c > 0)[at], times * np.log10(c + 0.5)[at], times * s[at] / np.log(10))]
                flags = pa.array(batch.column("flags")[k].as_py(), pa.int32()).cast(pa.bool_())
                yield pa.record_batch([pa.array(ids, pa.int64()), flags, *map(pa.array, sums)], ["doc_id", "train", "n_tokens", "n_known", "sum_log10", "score"])
                counts, scores = [], []

    rows = left.unionByName(right).repartition(partitions, "chunk").sortWithinPartitions("chunk", "bucket")
    return rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, sum_log10 double, score double")


def score_documents(docs: DataFrame, in_training: Column, model_file: str, rounds: int = EM_ROUNDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    base_score adds one half to each token's training count; score is the lattice model's
    log10 probability of the text.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = load_pieces(model_file)
    rows = stored(tokens_by_bucket(docs, in_training, partitions * BUCKETS_PER_PARTITION, id_col, text_col), "lattice-tokens")
    token_rows, triples = rows.where("kind = 0"), rows.where("kind = 1")
    words = stored(vocabulary(token_rows, partitions), "lattice-words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    log_p, whole = fit(words, pieces, rounds, int(n))
    sums = document_sums(answers(token_rows, pieces, log_p, whole, int(n), partitions), triples, partitions)
    unit = float(np.log10(n + 0.5 * (v + 1)))
    return sums.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("sum_log10") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score",
    )
