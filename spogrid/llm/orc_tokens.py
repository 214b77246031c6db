"""Token ids as ORC: encoding with a public tokenizer, files in id order, reading back.

Design. Rows are dealt to range partitions of ``doc_id`` and sorted there, so
each file holds one stretch of ids and files follow each other. The ids are an
``array<int>`` column, which ORC stores with its run-length encoding; every
stripe has row indexes (min and max of ``doc_id`` for each run of rows) and a
Bloom filter on ``doc_id``. Readers take stripes in parallel and skip those
that cannot hold the ids asked for.

Encoding lower-cases A-Z and cuts a text at ASCII white space, and between an
ASCII or Latin letter or digit and ASCII punctuation other than the
apostrophe. The tokenizer's normaliser does not reach over these places and
its pattern always ends a piece there, so no id spans a cut, and each distinct
piece is encoded by the library once and remembered. A piece of lower-case
letters is one piece of the pattern and goes to the library's model at once;
all others take its whole pipeline. Strings that look like special tokens are
ordinary text.

Defined cases: a null or empty text has the end id alone; rows with the same
``doc_id`` keep one row each, ordered by text; a null ``doc_id`` comes first;
an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spogrid.llm.shared import bounded_batches, shared_path
from spogrid.llm.textkit import LOWER, SOLID, SliceCache, byte_view, chunks, word_spans

END_ID = 1
_caches: dict[str, SliceCache] = {}

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False


def _encoder(tokenizer_file: str) -> SliceCache:
    """The worker's cache over the tokenizer; it outlives a task."""
    if tokenizer_file not in _caches:
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(tokenizer_file)
        tok.encode_special_tokens = True
        tok.no_truncation()
        tok.no_padding()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found: list = [None] * len(pieces)
            others, tokenize = [], tok.model.tokenize
            for k, piece in enumerate(pieces):
                if piece.isalpha():  # ASCII letters, lower-cased already
                    found[k] = [x.id for x in tokenize(piece.decode())]
                elif (text := piece.decode()).isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text):
                    found[k] = [x.id for x in tokenize(as_bytes.pre_tokenize_str(text)[0][0])]
                else:
                    others.append((k, text))
            for at in range(0, len(others), 20_000):
                part = others[at : at + 20_000]
                done = tok.encode([text for _, text in part], is_pretokenized=True, add_special_tokens=False)
                cut = np.searchsorted(np.array(done.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
                for (k, _), i, j in zip(part, cut[:-1], cut[1:], strict=True):
                    found[k] = done.ids[i:j] if j - i < len(done.ids) else done.ids
            return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

        _caches[tokenizer_file] = SliceCache(encode)
    return _caches[tokenizer_file]


def cut_pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the pieces of lower-cased bytes."""
    starts, ends, _ = word_spans(data, off, SOLID)
    alnum, mark = _ALNUM[data], _MARK[data]
    letter = alnum.copy()  # and the last byte of a Latin letter of two bytes
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & alnum[1:])) + 1
    inner = np.zeros(len(data) + 1, bool)
    inner[cut] = True
    inner[off] = False
    cut = np.flatnonzero(inner)
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def encode_texts(texts: pa.Array, cache: SliceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with the end id, and how many each has."""
    data, off = byte_view(texts)
    data = LOWER[data]
    starts, ends, _ = cut_pieces(data, off)
    ids, lens = cache.ids(data, starts, ends)
    total = np.concatenate([[0], np.cumsum(lens)])
    n = np.diff(total[np.searchsorted(starts, off)])
    ends_at = np.cumsum(n + 1) - 1
    out = np.full(len(ids) + len(n), END_ID, np.int32)
    body = np.ones(len(out), bool)
    body[ends_at] = False
    out[body] = ids
    return out, n + 1


def write_token_ids(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                    index_stride: int = 1000) -> None:
    """Encode every text and write (doc_id, seq, n_tokens, ids) as ORC in id order."""
    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _encoder(tokenizer_file)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, n = encode_texts(texts, cache)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))],
                    ["doc_id", "n_tokens", "ids"],
                )

    out = rows.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")
    # partition number above, row number below: ascending in the order of the files
    out = out.select("doc_id", F.monotonically_increasing_id().alias("seq"), "n_tokens", "ids")
    (out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", index_stride)
        .option("compression", "zstd").orc(path))


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows, of all documents or of some: those filters reach the
    files' stripe statistics, row indexes and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def stored_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of stored rows; start counts the ids before, in file order.

    Prefix sums go by file stretch: sums within each stretch, and the
    stretches' totals (one row for each writing task) over all.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            off = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("seq"), pa.array(np.diff(off), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "seq", "n_tokens", "ids_crc32"],
            )

    bounded_batches(rows)
    sums = rows.select("doc_id", "seq", "ids").mapInArrow(crc, "doc_id long, seq long, n_tokens long, ids_crc32 long")
    sums = sums.withColumn("stretch", F.shiftright("seq", 33))
    totals = rows.groupBy(F.shiftright("seq", 33).alias("stretch")).agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inner = Window.partitionBy("stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return sums.join(totals, "stretch").select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_to_orc(spark: SparkSession, docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write, read back and digest."""
    path = shared_path(spark, "token-ids")
    write_token_ids(docs, path, tokenizer_file)
    return stored_digest(read_token_ids(spark, path))
