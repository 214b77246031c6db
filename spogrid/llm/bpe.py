"""Byte-level BPE over a rank file: encoding and decoding.

Pre-tokenisation follows the public split pattern without a regex. Every
code point has a class (letter, number, space, other white space, other); with
one and three code points of lookahead this gives a symbol, and every symbol is
a function from automaton state to automaton state. Composition of such
functions is associative, so the state before each code point comes from a
blocked prefix scan over a composition table, for all texts of a chunk at
once; state and symbol say where a token begins. The slices between go
through pair merging by rank, each distinct slice once while it is cached.
Byte offsets of the tokens are kept, and decoding uses the ids alone.

Defined cases: a null or empty text has no ids and decodes to no bytes; every
row is encoded by itself, so ties, repeated ids and other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import bounded_batches
from spogrid.llm.textkit import SliceCache, byte_view, chunks, ragged

# Classes of code points.
OTHER, LETTER, NUMBER, BLANK, WHITE, QUOTE = range(6)
# Automaton states: what the token that is being read is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_WHITE, SUFFIX_1, SUFFIX_2 = range(8)
# Symbols: a code point with what its lookahead tells.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE_1, S_QUOTE_2, S_BLANK_LAST, S_WHITE_LAST, S_WHITE_ON = range(8)
# White space by Unicode's White_Space property, and the suffixes that an apostrophe begins.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
BLOCK = 64
# Slices up to this many bytes are merged many at once.
WIDEST = 40
NONE = 1 << 40


def code_point_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    points = np.arange(0x110000, dtype="<u4")
    every = np.concatenate([points[:0xD800], points[0xE000:]]).tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            table[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[WHITE_SPACE] = WHITE
    table[32], table[39] = BLANK, QUOTE
    return table


def _next(state: int, symbol: int) -> int:
    if symbol == S_LETTER:
        return {SUFFIX_2: SUFFIX_1, SUFFIX_1: FRESH}.get(state, IN_LETTERS)
    if symbol in (S_QUOTE_1, S_QUOTE_2):
        return IN_OTHERS if state in (IN_OTHERS, AFTER_BLANK) else SUFFIX_1 if symbol == S_QUOTE_1 else SUFFIX_2
    return {S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_BLANK_LAST: AFTER_BLANK}.get(symbol, IN_WHITE)


def _begins(state: int, symbol: int) -> bool:
    goes_on = {
        S_LETTER: (IN_LETTERS, AFTER_BLANK, SUFFIX_1, SUFFIX_2), S_NUMBER: (IN_NUMBERS, AFTER_BLANK),
        S_OTHER: (IN_OTHERS, AFTER_BLANK), S_QUOTE_1: (IN_OTHERS, AFTER_BLANK), S_QUOTE_2: (IN_OTHERS, AFTER_BLANK),
        S_WHITE_ON: (IN_WHITE,),
    }
    return state not in goes_on.get(symbol, ())


class Automaton:
    """Transition functions closed under composition, numbered; the first sixteen
    are those of the symbols, and of the symbols as a text's first."""

    def __init__(self) -> None:
        funcs = [tuple(_next(s, x) for s in range(8)) for x in range(8)]
        funcs += [(_next(FRESH, x),) * 8 for x in range(8)]
        known: dict[tuple, int] = {}
        self.of_symbol = np.array([known.setdefault(f, len(known)) for f in funcs], np.uint8)
        names, k = list(known), 0
        generators = list(known)
        while k < len(names):
            for g in generators:
                h = tuple(g[s] for s in names[k])
                if h not in known:
                    known[h] = len(known)
                    names.append(h)
            k += 1
        identity = tuple(range(8))
        if identity not in known:
            known[identity] = len(known)
            names.append(identity)
        m = len(names)
        assert m < 256
        self.identity = known[identity]
        #: compose[f * m + g]: first f, then g
        self.compose = np.array([known[tuple(g[s] for s in f)] for f in names for g in names], np.uint8)
        self.m = m
        #: begins[f * 8 + symbol]: a token begins here, when f leads from the beginning to here
        self.begins = np.array([[_begins(f[FRESH], x) for x in range(8)] for f in names], bool).ravel()

    def scan(self, f: np.ndarray) -> np.ndarray:
        """Exclusive prefix compositions of the functions f, by blocks."""
        n = len(f)
        if n <= 1:
            return np.full(n, self.identity, np.uint8)
        rows = -(-n // BLOCK)
        grid = np.full((BLOCK, rows), self.identity, np.uint8)
        padded = np.full(rows * BLOCK, self.identity, np.uint8)
        padded[:n] = f
        steps = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
        acc = np.full(rows, self.identity, np.uint8)
        for k in range(BLOCK):
            grid[k] = acc
            acc = self.compose[acc.astype(np.uint16) * self.m + steps[k]]
        before = self.scan(acc)
        if rows > 1:
            grid = self.compose[before.astype(np.uint16)[None, :] * self.m + grid]
        return np.ascontiguousarray(grid.T).ravel()[:n]


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray, automaton: Automaton) -> np.ndarray:
    """True where a token begins. first: True where a text begins; one entry more than points, True."""
    kind = classes[points]
    n = len(points)
    after = np.zeros(n + 3, np.uint32)
    after[:n] = points
    white = np.ones(n + 1, bool)
    white[:n] = (kind == BLANK) | (kind == WHITE)
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE_ON, S_WHITE_ON, S_OTHER], np.uint8)[kind]
    last = white[:n] & ~white[1:] & ~first[1:]
    symbol[last] = S_WHITE_LAST
    symbol[last & (kind == BLANK)] = S_BLANK_LAST
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        end = np.append(np.flatnonzero(first), n)  # a suffix does not reach into the next text
        room = end[np.searchsorted(end, quotes, "right")] - quotes - 1
        one, two = after[quotes + 1], after[quotes + 2]
        symbol[quotes[(room >= 1) & np.isin(one, [ord(x) for x in ONE_LETTER])]] = S_QUOTE_1
        for pair in TWO_LETTERS:
            symbol[quotes[(room >= 2) & (one == ord(pair[0])) & (two == ord(pair[1]))]] = S_QUOTE_2
    f = automaton.of_symbol[symbol + np.uint8(8) * first[:n]]
    return automaton.begins[automaton.scan(f) * np.uint16(8) + symbol] | first[:n]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is merged, the leftmost
    first, until none has a rank. A heap over linked parts: time n log n."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, rank_file: str):
        self.ranks = load_ranks(rank_file)
        self.classes, self.automaton = code_point_classes(), Automaton()
        self.cache = SliceCache(self._merge)
        size = max(self.ranks.values()) + 1
        by_id: list[bytes] = [b""] * size
        for token, k in self.ranks.items():
            by_id[k] = token
        self.token_lens = np.array([len(x) for x in by_id], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = np.fromiter(
            (n for x, k in self.ranks.items() for i in range(1, len(x)) if x[:i] in self.ranks and x[i:] in self.ranks
             for n in (self.ranks[x[:i]] << 32 | self.ranks[x[i:]], k)), np.int64,
        ).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.pair_ids = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    def _merge(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(slices)
        for k, x in enumerate(slices):
            if (whole := self.ranks.get(x)) is not None:
                found[k] = [whole]
            elif len(x) > WIDEST:
                found[k] = merge_long(x, self.ranks)
        rest = sorted((k for k, ids in enumerate(found) if ids is None), key=lambda k: len(slices[k]))
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for k, ids in zip(part, self._merge_together([slices[k] for k in part]), strict=True):
                found[k] = ids
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_ids[at], NONE)

    def _merge_together(self, slices: list[bytes]) -> list[list[int]]:
        """Pair merging of many slices at once, one merge of each in every round: a column for each slice."""
        wide = max(map(len, slices))
        raw = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in slices), np.uint8).reshape(len(slices), wide)
        size = np.array([len(x) for x in slices])
        parts = np.where(np.arange(wide)[:, None] < size, self.byte_ids[raw.T], -1)
        parts = np.concatenate([parts, np.full((1, len(slices)), -1, parts.dtype)])
        ranks = self._pair_ranks(parts[:-1], parts[1:])
        out = parts.copy()
        open_, rows = np.arange(len(slices)), np.arange(wide + 1)[:, None]
        while True:
            at = ranks.argmin(0)
            best = ranks[at, np.arange(len(at))]
            go = best < NONE
            if not go.all():
                out[:, open_[~go]] = parts[:, ~go]
                open_, parts, ranks, at, best = open_[go], parts[:, go], ranks[:, go], at[go], best[go]
                if not len(open_):
                    break
            col = np.arange(len(at))
            parts[at, col] = best
            parts = np.where(rows > at, np.concatenate([parts[1:], np.full((1, len(at)), -1, parts.dtype)]), parts)
            ranks = np.where(rows[:-1] > at, np.concatenate([ranks[1:], np.full((1, len(at)), NONE, ranks.dtype)]), ranks)
            ranks[at, col] = self._pair_ranks(parts[at, col], parts[at + 1, col])
            before = np.maximum(at - 1, 0)
            ranks[before, col] = np.where(at > 0, self._pair_ranks(parts[before, col], parts[at, col]), ranks[before, col])
        return [ids[ids >= 0].tolist() for ids in out.T]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        data, off = byte_view(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(at_byte, off)] = True
        starts = at_byte[np.flatnonzero(token_starts(points, first, self.classes, self.automaton))]
        ids, lens = self.cache.ids(data, starts, np.append(starts[1:], len(data)))
        total = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(total[np.searchsorted(starts, off)])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each id's token begins, and the end of all."""
        return np.concatenate([[0], np.cumsum(self.token_lens[ids])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids one after the other."""
        return self.token_bytes[ragged(self.token_starts[ids], self.token_lens[ids])]


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, offsets): ids of each text and the byte at which each id's token begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(rank_file)  # goes when the task ends
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, n = bpe.encode(texts)
                cut = np.concatenate([[0], np.cumsum(n)])
                at = bpe.offsets(ids)
                rel = at[:-1] - np.repeat(at[cut[:-1]], n)
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, rel)]
                yield pa.record_batch([part.column("doc_id"), *lists], ["doc_id", "ids", "offsets"])

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, text): the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(rank_file)  # goes when the task ends
        for batch in batches:
            texts = [None if ids is None else bpe.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    bounded_batches(encoded)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, digest both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(rank_file)  # goes when the task ends
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, n = bpe.encode(texts)
                cut = np.concatenate([[0], np.cumsum(n)])
                raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(bpe.decode(ids).tobytes())
                of = [(4 * cut).tolist(), bpe.offsets(ids)[cut].tolist()]
                sha = [[hashlib.sha256(m[a:b]).hexdigest() for a, b in zip(x[:-1], x[1:], strict=True)] for m, x in zip((raw, back), of, strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
