"""Operators on texts, against the public libraries and brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spogrid.llm import bpe, langmix, lattice_lm, license_scan, orc_tokens, queries, textkit, url_vocabulary

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, score string, id long, h int, n int"
ODD = [
    None, "", " ", "\n\n", "a", "it's 's ''s 'LL we'll\n'tis  x", "é ́x Σς ÀB passé,", "　x　 y", "a" * 3000, "ab " * 4000, "x\x00y\x1cz\x85w",
    "12.5% of <|endoftext|> «q»…—", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.", "a" * 300 + " " + "xyz" * 100,
]


def odd_rows(spark, texts=ODD):
    """Odd texts, with columns whose names the operators use inside; the first two rows once more."""
    rows = [(k, t, "s", -k, k, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def arrow(*texts):
    return pa.array(texts, pa.large_string())


text = st.text(alphabet=st.one_of(st.sampled_from("ab 's'tre\n\t.,!1é "), st.characters(exclude_categories=["Cs"])), max_size=60)


@given(st.lists(text, max_size=5))
@settings(max_examples=150, deadline=None)
def test_word_spans(texts):
    data, off = textkit.byte_view(arrow(*texts))
    data = textkit.LOWER[data]
    starts, ends, doc = textkit.word_spans(data, off, textkit.WORD)
    got = [(int(d), data[a:b].tobytes()) for a, b, d in zip(starts, ends, doc, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())]
    h = textkit.word_hashes(data, starts, ends)
    assert len({(int(x), w) for x, (_, w) in zip(h, got, strict=True)}) == len(set(h.tolist())) == len({w for _, w in got})


encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@given(st.lists(text, min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_librarys(texts):
    ids, n = bpe.ByteBpe(RANKS).encode(arrow(*texts))
    cut = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(cut.tolist())] == [encoding.encode_ordinary(t) for t in texts]
    assert bpe.ByteBpe(RANKS).decode(ids).tobytes() == "".join(texts).encode()


def test_long_and_short_merges_agree():
    model = bpe.ByteBpe(RANKS)
    some = [b"thththerewould", b"abcabcabc", "éèêë".encode(), b"x" * 39]
    assert model._merge_together(some) == [bpe.merge_long(x, model.ranks) for x in some]


def test_bpe_round_trip(spark):
    got = by_id(bpe.round_trip(odd_rows(spark), RANKS))
    for k, t in enumerate(ODD):
        ids = encoding.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert got[k] == {"doc_id": k, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(raw).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()}
    encoded = bpe.encode(odd_rows(spark), RANKS)
    assert all(r["text"] == (ODD[r["doc_id"]] or "") for r in bpe.decode(encoded, RANKS).collect())
    for r in encoded.collect():
        joined = [encoding.decode_single_token_bytes(i) for i in r["ids"]]
        assert r["offsets"] == [sum(map(len, joined[:k])) for k in range(len(joined))]
    assert bpe.round_trip(odd_rows(spark).limit(0), RANKS).count() == 0


@given(st.lists(text, min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_word_bpe_is_the_librarys(texts):
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    ids, n = orc_tokens.encode_texts(arrow(*texts), orc_tokens._encoder(WORDS))
    cut = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(cut.tolist())] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_slice_cache_keeps_within_its_limit():
    calls = []

    def encode(slices):
        calls.append(sorted(slices))
        return np.array([len(s) for s in slices], np.int32), np.ones(len(slices), np.int64)

    cache = textkit.SliceCache(encode, limit=2)
    for words in (b"a bb", b"ccc a", b"ccc bb"):
        data = np.frombuffer(words, np.uint8)
        starts, ends, _ = textkit.word_spans(data, np.array([0, len(data)]), textkit.SOLID)
        ids, lens = cache.ids(data, starts, ends)
        assert ids.tolist() == [len(w) for w in words.split()] and lens.tolist() == [1, 1]
    assert calls == [[b"a", b"bb"], [b"ccc"], [b"ccc"]] and len(cache.index) == 2


def test_spans_are_told_apart_by_their_bytes():
    """Words of equal polynomial hashes for every odd base, and texts of all lengths around the keys' borders."""
    w = "a"
    for _ in range(11):
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    words = [w, other, w] + ["x" * n + "yz"[n % 2] for n in range(20)] * 2 + ["q" * 8 + "r" * k + "s" * 8 for k in range(6)] + ["a\0", "a", "a\0\0"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    cut = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    a, b, which = textkit.distinct_spans(data, cut[:-1], cut[1:])
    assert [data[a[k] : b[k]].tobytes().decode() for k in which] == words and len(a) == len(set(words))
    text = f"{w}\n{other}"
    ids, n = bpe.ByteBpe(RANKS).encode(arrow(text, text))
    assert bpe.ByteBpe(RANKS).decode(ids[: n[0]]).tobytes().decode() == text
    whole = Tokenizer.from_file(WORDS)
    got, _ = orc_tokens.encode_texts(arrow(text), orc_tokens._encoder(WORDS))
    assert got.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_orc_tokens(spark, tmp_path):
    docs = odd_rows(spark)
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    got = sorted(map(tuple, orc_tokens.encode_to_orc(spark, docs, WORDS).collect()))
    expected, start = [], 0
    for k, t in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        expected.append((k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == sorted(expected)
    path = str(tmp_path / "ids")
    orc_tokens.write_token_ids(docs, path, WORDS)
    some = orc_tokens.read_token_ids(spark, path, [3, 99])
    assert [r["doc_id"] for r in some.collect()] == [3]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert orc_tokens.encode_to_orc(spark, docs.limit(0), WORDS).count() == 0


# -- the lattice model ----------------------------------------------------------------------------

def tiny_pieces(found):
    order = sorted(found)
    p = np.array([found[x] for x in order] + [found["</s>"]]) if "</s>" in found else np.array([found[x] for x in order] + [0.1])
    order = [x for x in order if x != "</s>"]
    return lattice_lm.Pieces(np.frombuffer("".join(order).encode(), np.uint8), np.cumsum([0, *map(len, order)]), p / p.sum()), order


def brute(word, p):
    """Sum over all segmentations."""
    if not word:
        return 1.0
    return sum(p[word[:k]] * brute(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_sums_all_segmentations():
    pieces, order = tiny_pieces({" ": 1, " a": 2, "a": 3, "b": 2, "ab": 4, "aba": 1, " ab": 2, "bb": 1})
    p = dict(zip(order, pieces.first_p, strict=False))
    lattice = lattice_lm.Lattice(pieces, np.log(pieces.first_p))
    words = ["", *("".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)), "ab" * 200]
    got = lattice.score([w.encode() for w in words], np.zeros(len(words)), 0.0, 1)
    assert got[0] == pytest.approx(math.log(pieces.first_p[-1]))
    for w, x in list(zip(words, got, strict=True))[1:-1]:
        assert x == pytest.approx(math.log(brute(" " + w, p)), rel=1e-9)
    # a long token, whose sums are carried on, against the recursion over all of it
    long = " " + words[-1]
    whole = lattice_lm.Lattice(pieces, np.log(pieces.first_p)).forward(lattice.piece_ids(np.frombuffer(long.encode(), np.uint8)[:, None]))
    assert got[-1] == pytest.approx(whole[-1, 0], rel=1e-9)


def test_expected_uses_are_those_of_all_segmentations():
    pieces, order = tiny_pieces({" ": 1, " a": 2, "a": 3, "b": 2, "ab": 4, " ab": 2})
    p = dict(zip(order, pieces.first_p, strict=False))
    lattice = lattice_lm.Lattice(pieces, np.log(pieces.first_p))
    got = lattice.expected([b"ab", b""], np.array([3.0, 2.0]), 0.0, 10)
    uses, total = Counter(), 0.0

    def walk(rest, used, weight):
        nonlocal total
        if not rest:
            total += weight
            for u in used:
                uses[u] += weight
        for k in range(1, len(rest) + 1):
            if rest[:k] in p:
                walk(rest[k:], [*used, rest[:k]], weight * p[rest[:k]])

    walk(" ab", [], 1.0)
    assert got[:-3] == pytest.approx([3 * uses[x] / total for x in order]) and got[-2] == 2 and got[-1] == 5


def plain_base(docs):
    train = Counter()
    words = {k: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [b"<end>"] for k, t in docs}
    for k, ws in words.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            train.update(ws)
    n, v = sum(train.values()), len(train)
    return {k: (zlib.crc32(str(k).encode()) % 5 == 1, len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for k, ws in words.items()}


def test_long_tokens_enter_the_fit(monkeypatch):
    pieces, order = tiny_pieces({" ": 1, " a": 2, "a": 3, "b": 2, "ab": 4, " ab": 2})
    lattice = lattice_lm.Lattice(pieces, np.log(pieces.first_p))
    words, counts = [b"ab" * 128, b"aab" * 400, b"b" * 700, b"ab"], np.array([1.0, 2.0, 1.0, 3.0])
    for whole in (0.0, 0.5):
        got = lattice.expected(words, counts, whole, 10)
        monkeypatch.setattr(lattice_lm, "SEGMENT", 1 << 20)
        assert got == pytest.approx(lattice.expected(words, counts, whole, 10), rel=1e-9)
        monkeypatch.undo()
    got = lattice.expected(words, counts, 0.0, 10)
    assert got[-1] == pytest.approx(7)
    assert sum(len(s) * got[k] for k, s in enumerate(order)) == pytest.approx(sum(c * (len(w) + 1) for w, c in zip(words, counts, strict=True)))
    # once in training, and so read through pieces alone, however unlikely
    assert lattice.expected([b"b" * 700], np.array([1.0]), 0.5, 10)[-1] == 1


def test_lattice_scores(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "CHUNK", 2000)  # several chunks
    texts = [*ODD, *("the cat sat on the mat " * (k % 4 + 1) + "Thing%d" % (k % 7) for k in range(40))]
    rows = spark.createDataFrame([(k, t, "s", -k, k, 1) for k, t in enumerate(texts)], SCHEMA)
    got = by_id(lattice_lm.score_documents(rows, queries._fold("doc_id", 5) != 1, public_tokenizers.path("piece_bpe_32k.model"), rounds=1))
    want = plain_base(list(enumerate(texts)))
    for k, (held, n, known, total, base) in want.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and -1e6 < r["score"] < 0
    assert lattice_lm.score_documents(rows.limit(0), F.lit(True), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    none = lattice_lm.score_documents(rows, F.lit(False), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(none) == len(texts) and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)


# -- language ---------------------------------------------------------------------------------------

def test_trigram_cells():
    data = np.frombuffer(b"ab c", np.uint8)
    cells, first = langmix.trigram_cells(data, np.array([0, 3]), np.array([2, 4]))
    of = lambda *s: (s[0] * 64 + s[1]) * 64 + s[2]
    assert cells.tolist() == [of(0, 0, 1), of(0, 1, 2), of(1, 2, 0), of(0, 0, 3), of(0, 3, 0)] and first.tolist() == [0, 3]


def test_mixture_finds_the_proportions():
    log_p = np.log(np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 10))
    share, like = langmix.mixture(log_p, np.array([0]), np.ones((1, 2), bool), rounds=200)
    grid = np.linspace(0.001, 0.999, 999)
    best = [(np.log(np.exp(log_p) @ [a, 1 - a]).sum(), a) for a in grid]
    assert share[0, 0] == pytest.approx(max(best)[1], abs=2e-3) and like[0] == pytest.approx(max(best)[0], abs=1e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_language_mixture(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(r["mixture"].values()) - 1) < 1e-6 for r in got)


def test_language_odd_texts(spark):
    learn = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langmix.learn(learn, F.lit(True))
    assert model.langs == ("de", "en")
    odd = odd_rows(spark, [None, "", "12 !?", "…—", "日本語", "the dog", "der Hund und die Katze " * 30 + "the cat and the dog " * 30])
    got = by_id(langmix.predict(odd, model))
    assert [got[k]["lang_pred"] for k in range(4)] == ["und"] * 4 and [got[k]["score"] for k in range(4)] == [0] * 4
    assert got[4]["lang_pred"] in model.langs and got[5]["lang_pred"] == "en"
    assert got[6]["mixture"].keys() == {"de", "en"}
    assert langmix.keep(odd, model).columns == odd.columns
    assert sorted(r["doc_id"] for r in langmix.keep(odd, model).collect()) == [4, 5, 6]
    nothing = langmix.learn(learn.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langmix.predict(odd, nothing).collect()} == {"und"}
    assert langmix.predict(odd.limit(0), model).count() == 0


# -- licences ---------------------------------------------------------------------------------------

NOTICES = ["Licensed under CC BY 4.0", "CC-BY", "ccby", "GNU General  Public\nLicence v3", "general publik licence", "All rights\nreserved. all rights reserved", "All right reserved", "Apache License, Version 2.0", "MIT License", "general public", "xall rights reservedx", "cc by general public license all rights reserved"]


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy(words, notice):
    """Whether some run of whole words is within the notice's edits."""
    phrase, e = notice.phrase.encode(), notice.errors
    letters = Counter(phrase)
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + 12) + 1):
            run = b" ".join(words[i:j])
            if len(run) > len(phrase) + e:
                break
            if len(run) >= len(phrase) - e and sum(((c := Counter(run)) - letters).values()) <= e and sum((letters - c).values()) <= e and edits(run, phrase) <= e:
                return True
    return False


def plain_licenses(t):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    base = [(i, label) for label, phrase in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    at = [i for i, _ in base]
    names = {label for _, label in base}
    every = names | {n.label for n in license_scan.NOTICES if fuzzy(words, n)}
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(every)))


def test_notices_cut_off_at_the_ends_of_a_text():
    cut = ["mit licens", "public domai", "all rights reserv", "it license", "ublic domain", "l rights reserved"]
    texts = [x for c in cut for x in (c, "see " + c, c + " see", c + ".")]
    _, found = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES).scan(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        c = cut[k // 4]
        errors = {"mit licens": 1, "it license": 1, "public domai": 1, "ublic domain": 1}.get(c, 2)
        assert [(text[h["begin"] : h["end"]], h["edits"]) for h in found[k]] == [(c, errors)], text
    _, found = license_scan.Scanner(license_scan.BASE, license_scan.NOTICES).scan(pa.array(["xall rights reservedx"], pa.large_string()))
    assert [h["edits"] for h in found[0]] == [2]  # letters put in at both ends


def test_licenses(spark):
    texts = [*ODD, *NOTICES, "x " * 500 + " ".join(NOTICES), *("Some text. " + a + "\n" + b for a, b in itertools.permutations(NOTICES[:6], 2))]
    found = license_scan.scan(odd_rows(spark, texts))
    got = by_id(license_scan.digest(found))
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == plain_licenses(t), t
        assert 0 <= r["score"] <= 1
    exact = [h for h in found.where(f"doc_id = {len(ODD)}").first()["hits"] if h["base"]]
    assert [NOTICES[0][h["begin"] : h["end"]] for h in exact] == ["CC BY"]
    for k, t in enumerate(texts):
        r, raw = got[k], (t or "").encode().lower()
        assert [s["begin"] for s in r["spans"]] == sorted(s["begin"] for s in r["spans"]), k
        assert {s["label"] for s in r["spans"]} == set(filter(None, r["labels"].split(",")))
        exact = [b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", raw[s["begin"] : s["end"]])).decode() for s in r["spans"] if s["base"]]
        assert len(exact) == r["n_base"] and set(exact) <= {phrase for _, phrase in license_scan.BASE}
    assert license_scan.digest(license_scan.scan(odd_rows(spark).limit(0))).count() == 0


def test_pieces_cover_the_notice():
    for n in license_scan.NOTICES:
        assert b"".join(p for _, p in license_scan.pieces(n)) == n.phrase.encode() and len(license_scan.pieces(n)) == n.errors + 1


# -- urls -------------------------------------------------------------------------------------------

def test_urls(spark):
    urls = {
        "https://A.Example.ORG/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12#f": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/?a": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/fr/casino": ("x.com", "/fr/casino", "com/fr/", "allow"),
        "http://x.com/casino": ("x.com", "/casino", None, "block"),
        "http://x.com/casinos": ("x.com", "/casinos", None, "allow"),
        "http://cheap-pills.net": ("cheap-pills.net", "", None, "block"),
        "http://cheap.net/cheap": ("cheap.net", "/cheap", None, "allow"),
        "http://x.net?u=http://org/": ("x.net", "", None, "allow"),
        "no scheme/free/win": ("", "", None, "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = by_id(url_vocabulary.judge(rows), "page_id")
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(got.items())] == list(urls.values())
    assert got[8]["soft_terms"] == ["cheap", "pills"]
    assert url_vocabulary.judge(rows.limit(0)).count() == 0
    import duckdb

    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": list(range(len(urls))), "url": list(urls)}))
    sql = con.execute(url_vocabulary.sql() + " ORDER BY page_id").fetchall()
    assert [r[1:] for r in sql] == list(urls.values())


def test_quality_holds_little_beside_a_batch():
    """What a task holds for word vectors and pooling, over 4 MB of text in one batch."""
    import tracemalloc

    from spogrid.llm import quality

    batch = pa.record_batch([pa.array(["a quality text, with marks; " * 40] * 3_700)], ["text"])
    index = quality.index_vectors()
    tracemalloc.start()
    try:
        for _, texts in quality.chunks(batch, "text", quality.CHUNK):
            quality.context_sums(*quality.token_cells(texts), index)
            quality.pool(*quality.token_cells(texts), len(texts), index)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
