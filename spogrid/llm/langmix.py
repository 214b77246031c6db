"""Language identification as inference of a mixture.

Model. Every learned language has a table of letter trigrams: the logarithm of
the probability of a symbol after the two before it, within words, smoothed
towards all languages together. A symbol stands for a-z, the end of a word, or
a few of the bytes from 0x80, so that the tables have 64 ** 3 cells. They
count all rows that may be learned from.

Inference. A document is a mixture of languages: each word comes from one of
them, with the document's proportions. Expectation-maximisation finds the
proportions. For k = 1, 2, ... the k strongest languages of the full mixture
are fitted by themselves, and the set with the best likelihood less a penalty of
half the logarithm of the number of words for each further language is taken
(the Bayesian information criterion). A document whose full mixture does not
beat its best single language by one penalty needs no further fits, as no set can be
likelier than the full one. The prediction is the strongest language of the
set, the score its proportion.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
a text with letters that no learned language knows gets the language whose
general smoothing suits it best; when nothing can be learned
every text is ``und``; ties go to the language that comes first in the
alphabet; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import bounded_batches
from spogrid.llm.textkit import LOWER, byte_view, chunks, kept, word_spans

UNKNOWN = "und"
SYMBOLS = 64
CELLS = SYMBOLS**3
SMOOTHING = 5.0
ROUNDS = 12
_SYMBOL = np.zeros(256, np.int32)  # 0: the end of a word
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 37
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


class LangModel(NamedTuple):
    langs: tuple[str, ...]
    log_p: np.ndarray  # cell x language
    words: np.ndarray  # share of each language in the words learned from


def letter_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z and the Latin-1 capitals lower-cased."""
    data, off = byte_view(texts)
    data = LOWER[data]
    if len(data):
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = data + np.uint8(0x20) * capital
    return data, off


def trigram_cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of all words, one for each byte and one for the end, and the first of each word."""
    lens = ends - starts
    first = np.cumsum(lens + 1) - (lens + 1)
    n = int((lens + 1).sum())
    flat = np.zeros(n + 2, np.int32)  # two marks, then each word and a mark
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    place = np.ones(n + 2, bool)
    place[:2] = place[first + lens + 2] = False
    flat[place] = _SYMBOL[data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]]
    before = flat[:-2].copy()  # two places before: a mark for a word's first two bytes
    before[(first + 1)[lens >= 1]] = 0
    before[first] = 0
    return (before * SYMBOLS + flat[1:-1]) * SYMBOLS + flat[2:], first


def learn(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Trigram tables from every usable row with a language and a text.

    A task sends at most one row for each cell and language, and so does the
    sum of all tasks to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        words: dict[str, int] = {}
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                data, off = letter_bytes(texts)
                starts, ends, doc = word_spans(data, off, _LETTER)
                names, which = np.unique(np.array(part.column("lang").to_pylist()), return_inverse=True)
                cell, _ = trigram_cells(data, starts, ends)
                lang = np.repeat(which[doc], ends - starts + 1)
                for k, name in enumerate(names.tolist()):
                    table = tables.setdefault(name, np.zeros(CELLS, np.int64))
                    table += np.bincount(cell[lang == k], minlength=CELLS)
                    words[name] = words.get(name, 0) + int((which[doc] == k).sum())
        for name, table in tables.items():
            at = np.flatnonzero(table)
            cells, n = np.append(at, CELLS), np.append(table[at], words[name])  # the last cell holds the words
            yield pa.record_batch([pa.array([name] * len(cells)), pa.array(cells), pa.array(n)], ["lang", "cell", "n"])

    bounded_batches(docs)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    return build(counts.toPandas())


def build(counts: pd.DataFrame) -> LangModel:
    """The model from (lang, cell, n)."""
    langs = tuple(sorted(counts["lang"].unique()))
    if not langs:
        return LangModel((), np.zeros((CELLS, 0), np.float32), np.zeros(0))
    n = np.zeros((CELLS + 1, len(langs)))
    n[counts["cell"], np.searchsorted(np.array(langs), counts["lang"].to_numpy().astype(str))] = counts["n"]
    words, n = n[-1], n[:-1]
    after = lambda x: np.repeat(x.reshape(-1, SYMBOLS, x.shape[1]).sum(1), SYMBOLS, axis=0)
    every = n.sum(1, keepdims=True)
    general = (every + 0.1) / (after(every) + 0.1 * SYMBOLS)
    log_p = np.log((n + SMOOTHING * general) / (after(n) + SMOOTHING))
    return LangModel(langs, log_p.astype(np.float32), (words + 1) / (words + 1).sum())


def mixture(word_log_p: np.ndarray, first: np.ndarray, member: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every document by expectation-maximisation.

    word_log_p: word x language; first: each document's first word (every document has
    one); member: document x language, True where the language may take part.
    """
    sizes = np.diff(np.append(first, len(word_log_p)))
    top = word_log_p.max(1)
    like = np.exp(word_log_p - top[:, None])
    share = member / member.sum(1, keepdims=True)
    for _ in range(rounds):
        weight = like * np.repeat(share, sizes, axis=0)
        total = np.maximum(weight.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(weight / total, first, axis=0) / sizes[:, None]
    total = np.maximum((like * np.repeat(share, sizes, axis=0)).sum(1), 1e-300)
    return share, np.add.reduceat(np.log(total) + top, first)


def infer(model: LangModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and proportions (document x language) of every text."""
    n, k_all = len(texts), len(model.langs)
    data, off = letter_bytes(texts)
    starts, ends, doc = word_spans(data, off, _LETTER)
    share = np.zeros((n, k_all))
    docs = np.unique(doc)
    if not k_all or not len(docs):
        return [UNKNOWN] * n, np.zeros(n), share
    cell, first = trigram_cells(data, starts, ends)
    word = np.add.reduceat(model.log_p[cell], first, axis=0).astype(np.float64)
    begin = np.searchsorted(doc, docs)
    sizes = np.diff(np.append(begin, len(doc)))
    penalty = 0.5 * np.log(sizes + 1.0)
    full, like_full = mixture(word, begin, np.ones((len(docs), k_all), bool))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    single = np.add.reduceat(word, begin, axis=0)
    chosen = np.eye(k_all)[single.argmax(1)]
    best = single.max(1)
    unsure = np.flatnonzero(like_full - best > penalty)
    if len(unsure):
        mine = np.zeros(len(docs), bool)
        mine[unsure] = True
        part = word[np.repeat(mine, sizes)]
        at = np.cumsum(sizes[unsure]) - sizes[unsure]
        top = best[unsure]
        for k in range(2, k_all + 1):
            got, like = mixture(part, at, rank[unsure] < k)
            like -= (k - 1) * penalty[unsure]
            better = like > top
            chosen[unsure[better]], top = got[better], np.maximum(top, like)
    share[docs] = chosen
    names, score = [UNKNOWN] * n, np.zeros(n)
    has_letter = [True] * n
    plain = np.add.reduceat((data[starts] < 128).astype(np.int64), begin)  # words that begin with an ASCII letter
    for d in docs[plain == 0].tolist():
        has_letter[d] = any(c.isalpha() for c in texts[d].as_py())
    for d, k in zip(docs.tolist(), chosen.argmax(1).tolist(), strict=True):
        if has_letter[d]:
            names[d], score[d] = model.langs[k], share[d, k]
        else:
            share[d] = 0
    return names, np.clip(score, 0, 1), share


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture): mixture holds the selected languages and their proportions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                names, score, share = infer(model, texts)
                mixed = [[(model.langs[k], float(row[k])) for k in np.argsort(-row, kind="stable") if row[k] > 0] for row in share]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "lang_pred", "score", "mixture"],
                )

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def keep(docs: DataFrame, model: LangModel, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents with a language, that has at least that share of their words, with all their columns."""

    def judge():
        def decide(texts: pa.Array) -> np.ndarray:
            names, score, _ = infer(model, texts)
            return (np.array(names) != UNKNOWN) & (score >= least)

        return decide

    return kept(docs, text_col, judge)
