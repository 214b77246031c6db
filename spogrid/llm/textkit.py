"""Text helpers that the operators share: byte views of Arrow strings, word
boundaries and word hashes as numpy arrays, and a bounded cache of encoded slices.

Everything works on chunks of a few MB, so that the memory of a task does not
depend on the number of rows in an Arrow batch; a single longer text makes a
chunk of its own and is never cut.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spogrid.llm.shared import bounded_batches

CHUNK_BYTES = 1 << 20

# Bytes of a word: 0-9, a-z and all bytes from 0x80 (letters outside ASCII); A-Z are lower-cased first.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
# Bytes of a token that white space (space, tab to carriage return) ends.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as plain strings, null as empty."""
    return batch.column(name).cast(pa.large_string()).fill_null("")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more at the end)."""
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows of about ``limit`` bytes of text each, with that column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        part = batch.slice(at, end - at)
        yield part, text_column(part, name)
        at = end


def kept(docs: DataFrame, name: str, judge: Callable[[], Callable[[pa.Array], np.ndarray]], limit: int = CHUNK_BYTES) -> DataFrame:
    """The rows whose text the judge keeps, with all their columns. ``judge`` is called once in each
    task, and what it returns gives True or False for each of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for batch in batches:
            for part, texts in chunks(batch, name, limit):
                yield part.filter(pa.array(decide(texts), pa.bool_()))

    bounded_batches(docs)
    return docs.mapInArrow(run, docs.schema)


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every maximal run of bytes that ``inside`` marks, within each text."""
    n = len(data)
    mark = np.zeros(n + 1, bool)
    mark[:n] = inside[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = mark.copy()
    begins[1:] &= ~mark[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    ends_at = mark[:n] & (~mark[1:] | first[1:])
    ends = np.flatnonzero(ends_at) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        one = np.ones(1, np.uint64)
        _powers[:] = [np.cumprod(np.concatenate([one, np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on its bytes alone (polynomial prefix sums)."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    np.cumsum(terms, out=sums[1:])
    del terms
    return mix((sums[ends] - sums[starts]) * down[starts])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, all in one array."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total, dtype=np.int64)


_KEY = b"spans of bytes"
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last eight bytes of each span: all of a span of up to 16 bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    lens = ends - starts
    return lens, eight[starts] & _MASKS[np.minimum(lens, 8)], np.where(lens > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    lens, low, high = parts
    keys = mix(mix(mix(low ^ _BASE) + high) + lens.astype(np.uint64))
    long = np.flatnonzero(lens > 16)
    if len(long):
        raw = data.tobytes()
        spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        keys[long] = np.frombuffer(b"".join(blake2b(raw[i:j], digest_size=8, key=_KEY).digest() for i, j in spans), "<u8")
    return keys


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each span: of its first and last eight bytes and its length, or
    of all its bytes (BLAKE2b) where it is longer than 16."""
    return _keys(data, starts, ends, _parts(data, starts, ends))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of one span for each distinct content, and which of them each span is.

    Spans are grouped by their keys, and then compared byte by byte with the one that stands for
    the group; those that differ make groups of their own.
    """
    lens, low, high = parts = _parts(data, starts, ends)
    _, rep, which = np.unique(_keys(data, starts, ends, parts), return_index=True, return_inverse=True)
    as_rep = rep[which]
    differ = (lens != lens[as_rep]) | (low != low[as_rep]) | (high != high[as_rep])
    long = np.flatnonzero((lens > 16) & ~differ & (as_rep != np.arange(len(lens))))
    if len(long):
        same = data[ragged(starts[long], lens[long])] == data[ragged(starts[as_rep[long]], lens[long])]
        differ[long] = ~np.logical_and.reduceat(same, np.cumsum(lens[long]) - lens[long])
    if differ.any():
        own: dict[bytes, int] = {}
        first = []
        for k in np.flatnonzero(differ).tolist():
            content = data[starts[k] : ends[k]].tobytes()
            if content not in own:
                own[content] = len(rep) + len(first)
                first.append(k)
            which[k] = own[content]
        rep = np.concatenate([rep, np.array(first, rep.dtype)])
    return starts[rep], ends[rep], which


class SliceCache:
    """Ids of text slices. ``encode`` gets the slices not known yet and returns
    their ids one after the other and how many each has. Slices of up to ``longest`` bytes stay from one chunk to
    the next, the first ones seen, at most ``limit`` of them and ``limit_bytes`` of memory in all; frequent slices are among them.
    """

    longest = 200
    # Bytes that a known slice takes besides its own and those of its ids: object, place in the index, start.
    each = 160

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 300_000, limit_bytes: int = 32 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.index: dict = {}
        self.flat, self.start = array("i"), array("q", [0])
        self.taken = 0

    def add(self, keys: list, ids: np.ndarray, lens: np.ndarray) -> None:
        at = len(self.index)
        self.index.update(zip(keys, range(at, at + len(keys)), strict=True))
        base = self.start[-1]
        self.flat.frombytes(np.ascontiguousarray(ids, np.int32).tobytes())
        self.start.frombytes((base + np.cumsum(lens)).astype(np.int64).tobytes())

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans of the bytes, one after the other, and how many each span has."""
        a, b, which = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        slices = [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        missing = [x for x in slices if x not in self.index]
        missing.sort(key=lambda x: len(x) > self.longest)
        stay = len(self.index)
        if missing:
            found, n = self.encode(missing)
            cost = np.fromiter(map(len, missing), np.int64, len(missing)) + 4 * np.asarray(n) + self.each
            short = sum(len(x) <= self.longest for x in missing)
            taken = self.taken + np.cumsum(cost[:short])
            kept = min(int(np.searchsorted(taken, self.limit_bytes, "right")), max(0, self.limit - stay))
            self.taken = int(taken[kept - 1]) if kept else self.taken
            stay += kept
            self.add(missing, found, n)
        at = np.fromiter(map(self.index.__getitem__, slices), np.int64, len(slices))[which]
        start = np.frombuffer(self.start, np.int64).copy()
        first, lens = start[at], start[at + 1] - start[at]
        flat = np.frombuffer(self.flat, np.int32).copy() if self.flat else np.zeros(0, np.int32)
        out = flat[ragged(first, lens)]
        if len(self.index) > stay:
            for key in missing:
                if self.index[key] >= stay:
                    del self.index[key]
            del self.flat[self.start[stay] :]
            del self.start[stay + 1 :]
        return out, lens
