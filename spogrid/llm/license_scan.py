"""Licence notices in texts: exact phrases, and short notices with a few edits.

A text is lower-cased (A-Z) and taken as words of 0-9, a-z and bytes from 0x80.
Exact phrases are found by the hashes of consecutive words and compared byte
by byte. For fuzzy search the words are joined by single spaces; a notice that
may have e edits is cut into e + 1 pieces, one of which must occur unchanged,
so the places of all pieces are the only candidates; there the regex library's
bounded-error matching looks for the notice as whole words and counts its edits.

Defined cases: a null or empty text has no words and no hits; equal rows get
equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import bounded_batches
from spogrid.llm.textkit import LOWER, WORD, byte_view, chunks, word_hashes, word_spans


class Notice(NamedTuple):
    label: str
    phrase: str
    errors: int


# Phrases found as they stand, with their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Notices found with up to so many edits.
NOTICES = (
    Notice("gpl", "general public license", 2),
    Notice("gpl", "gnu general public license", 3),
    Notice("reserved", "all rights reserved", 2),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by-nc", "cc by nc", 0),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("apache", "apache license version", 2),
    Notice("mit", "mit license", 1),
    Notice("bsd", "bsd license", 1),
    Notice("mpl", "mozilla public license", 2),
    Notice("lgpl", "lesser general public license", 2),
    Notice("public-domain", "public domain", 1),
)

HITS = "array<struct<label:string,base:boolean,word:long,begin:long,end:long,edits:int>>"
_HIT = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def pieces(notice: Notice) -> list[tuple[int, bytes]]:
    """The notice cut into errors + 1 pieces: where each begins, and its bytes."""
    raw, k = notice.phrase.encode(), notice.errors + 1
    cut = [len(raw) * i // k for i in range(k + 1)]
    return [(a, raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Scanner:
    def __init__(self, base: Sequence[tuple[str, str]], notices: Sequence[Notice]):
        self.base = [(label, [w.encode() for w in phrase.split()]) for label, phrase in base]
        self.notices = [
            (n, pieces(n), regex.compile(rb"(?b)(?<![^ \n])(?:%s){e<=%d}(?![^ \n])" % (regex.escape(n.phrase.encode(), literal_spaces=True), n.errors)))
            for n in notices
        ]

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Number of words and hits of each text."""
        data, off = byte_view(texts)
        data = LOWER[data]
        starts, ends, doc = word_spans(data, off, WORD)
        word_at = np.searchsorted(starts, off)
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        hashes = word_hashes(data, starts, ends)
        for label, words in self.base:
            flat = np.frombuffer(b"".join(words), np.uint8)
            cut = np.cumsum([0, *map(len, words)])
            keys = word_hashes(flat, cut[:-1], cut[1:])
            n = max(0, len(starts) - len(words) + 1)
            same = np.ones(n, bool)
            for k, key in enumerate(keys):
                same &= hashes[k : k + n] == key
            for i in np.flatnonzero(same).tolist():
                j = i + len(words) - 1
                if doc[i] == doc[j] and all(data[starts[i + k] : ends[i + k]].tobytes() == w for k, w in enumerate(words)):
                    at = off[doc[i]]
                    found[doc[i]].append({"label": label, "base": True, "word": i - int(word_at[doc[i]]), "begin": int(starts[i] - at), "end": int(ends[j] - at), "edits": 0})
        self._fuzzy(data, off, starts, doc, word_at, found)
        return np.diff(word_at), found

    def _fuzzy(self, data, off, starts, doc, word_at, found) -> None:
        # words joined by one blank, texts by a line feed; source: where each byte came from
        n = len(data)
        if not n:
            return
        inside = WORD[data]
        last = np.zeros(n, bool)
        last[off[1:][off[1:] > 0] - 1] = True
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep |= last
        joined = np.where(inside, data, 32).astype(np.uint8)
        extra = np.flatnonzero(last & inside)  # a word that ends its text needs a separator of its own
        joined[last & ~inside] = 10
        source = np.flatnonzero(keep)
        flat = joined[source]
        if len(extra):
            at = np.searchsorted(source, extra) + 1
            flat, source = np.insert(flat, at, 10), np.insert(source, at, extra)
        raw = flat.tobytes()
        seen: set[tuple] = set()
        for notice, parts, pattern in self.notices:
            size = len(notice.phrase)
            for shift, piece in parts:
                at = raw.find(piece)
                while at >= 0:
                    lo, hi = max(0, at - shift - notice.errors), at - shift + size + notice.errors
                    lo = max(lo, raw.rfind(b"\n", lo, at) + 1)
                    stop = raw.find(b"\n", at, hi + 1)
                    hi = min(hi, stop if stop >= 0 else len(raw))
                    # a byte more on either side tells whether a word ends there; a text's own ends tell it themselves
                    first, end = lo == 0 or raw[lo - 1] == 10, hi + (hi < len(raw) and raw[hi] != 10)
                    m = pattern.search(raw, lo if first else lo - 1, end)
                    if first:  # a search puts in nothing where it begins, a match does
                        m = min(filter(None, (m, pattern.match(raw, lo, end))), key=lambda m: sum(m.fuzzy_counts), default=None)
                    if m:
                        a, b = source[m.start()], source[m.end() - 1] + 1
                        k = int(np.searchsorted(off, a, "right") - 1)
                        key = (notice.label, k, int(a))
                        if key not in seen:
                            seen.add(key)
                            word = int(np.searchsorted(starts, a, "right") - 1) - int(word_at[k])
                            found[k].append({"label": notice.label, "base": False, "word": word, "begin": int(a - off[k]), "end": int(b - off[k]), "edits": sum(m.fuzzy_counts)})
                    at = raw.find(piece, at + 1)


def scan(docs: DataFrame, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits): every hit has label, whether it is an exact base phrase,
    its first word, its bytes [begin, end) in the text and its edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                n, found = scanner.scan(texts)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, _HIT)], ["doc_id", "n_words", "hits"])

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, hits {HITS}")


def _span(hit: Column) -> Column:
    return F.struct(*(hit[c].alias(c) for c in ("begin", "end", "label", "base", "edits")))


def digest(found: DataFrame, notices=NOTICES) -> DataFrame:
    """One row for each document: counts, first and last base hit, labels, the best hit's likeness, and
    the spans of all hits (bytes of the text, label, whether exact, edits) in order of their place."""
    sizes = F.create_map(*[x for label, size in sorted({n.label: len(n.phrase) for n in notices}.items()) for x in (F.lit(label), F.lit(size))])
    exact = F.filter("hits", lambda h: h.base)
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h.label))), ",")
    words = F.transform(exact, lambda h: h.word)
    like = F.transform("hits", lambda h: F.when(h.base, 1.0).otherwise(1.0 - h.edits / F.try_element_at(sizes, h.label)))
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), names(exact).alias("base_labels"), names(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(like), F.lit(0.0)).alias("score"), F.array_sort(F.transform("hits", _span)).alias("spans"),
    )
