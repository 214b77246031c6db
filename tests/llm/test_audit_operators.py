"""Merkle manifest, code search and filter audit, against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from spogrid.llm import code_search, filter_audit, merkle_manifest, queries
from tools.check import rows_of

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, c int, rank int"
LABELS = "doc_id long, quality int, toxic int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "leaf", "key", 1, 2) for r in rows], DOCS)


@pytest.mark.parametrize("key", ["op11_merkle_manifest", "op13_filter_audit"])
def test_queries_match_their_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.queries()[key](spark, SMALL)
    cur = con.execute(queries.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


# -- Merkle manifest ---------------------------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    values = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels from the nodes to one, three at a time."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def sides(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[k] = climb([leaf_of(*r) for r in groups[k]])
    top = climb([trees[k][-1][0] for k in keys])
    out = []
    for q, k in enumerate(keys):
        for at, r in enumerate(groups[k]):
            path = sides(trees[k], at) + sides(top, q)
            node = leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                node = leaf_of(r[0], r[1].replace("\n", ""), *r[2:])
            for a, b in path:
                node = sha(a + node + b)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], leaf_of(*r), trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def manifest_rows(spark, rows):
    got = merkle_manifest.manifest(docs_frame(spark, rows), tampered=merkle_manifest.tampered_rows())
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(tuple(r[c] for c in cols) for r in got.collect())


def test_manifest_of_odd_rows(spark):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "a\nb", "ü\n\n", "plain", "x" * 50_000 + "\n"])
    rows = [(rng.randrange(-70_000, 70_000), text(), rng.choice([None, "en"]), rng.choice([None, "", "a", "ä", "b"]), rng.choice([None, 3])) for _ in range(120)]
    rows += [(7, "twice\n", "en", "a", 1), (7, "twice\n", "en", "a", 1), (7, "other", "en", "a", 1), (None, "no id\n", None, "a", None), (None, None, None, "a", None)]
    rows += [(None, "no id\n", None, "a", None), (5, "lone\n", "en", "single", 4), (-(1 << 62), "low", "en", "a", 1), ((1 << 63) - 1, "high", "en", "a", 1)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_large_sources(spark):
    """More rows than a block, dense containers of ids, and a source with most of the rows."""
    rows = [(k * 3 if k < 900 else 40_000 + k, f"t{k}\n" if k % 5 else "t", "en", "hot" if k % 3 else f"s{k % 9}", k) for k in range(2300)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(4, "a\n", "en", "s", 2)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)
    assert manifest_rows(spark, []) == Counter()


# -- code search -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row long, v string, score int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "v", 2) for i, v in rows], VECTORS)


def brute(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) of the exact search, for each row that asks."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every:
            continue
        scored = []
        for b, (j, x) in enumerate(ok):
            if a != b and len(x) == len(q):
                total = 0.0
                for m, n in zip(q.tolist(), x.tolist(), strict=True):
                    total += m * n
                scored.append((-total, j))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return out


def found(spark, rows, **args):
    return [tuple(r) for r in code_search.nearest(vector_frame(spark, rows), **args).collect()]


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24))
    rows = [(int(k), (centres[k % 12] * rng.uniform(0.2, 3) + 0.4 * rng.standard_normal(24)).tolist()) for k in range(1500)]
    got, want = found(spark, rows, block_bytes=1 << 16), brute(rows)
    assert len(got) == len(want)
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.97 * len(want)
    exact = {(q, i): s for q, _, i, s in brute(rows, k=1500)}
    assert all(s == exact[q, i] for q, _, i, s in got)


def test_search_recall_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got, want = queries.op12_code_search(spark, "/root/testdata/sf0.01"), brute(rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    have = {(r["query_id"], r["vec_id"]) for r in got.collect()}
    assert len(have & {(r[0], r[2]) for r in want}) >= 0.95 * len(want)


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1e18, 1.0]), (10, [-1e-20, 0.0]), (11, [0.5, 0.5, 0.5]), (40, [0.0, 0.0]), (60, [1.0, 2.0, 3.0]), (80, None)]
    rows += [(1, [1.0, 0.0]), (20, [2.0, 0.0])]
    assert sorted(found(spark, rows)) == sorted(brute(rows))
    assert sorted(found(spark, rows, k=2)) == sorted(brute(rows, k=2))
    assert found(spark, []) == []
    assert found(spark, [(20, [1.0])]) == []


def test_substring_index_finds_every_code_within_a_distance():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 256, (300, code_search.BITS // 8), np.uint8)
    query = code[:6].copy()
    for k, flips in enumerate((0, 5, 20, 40, 60, 90)):
        at = rng.choice(code_search.BITS, flips, replace=False)
        np.bitwise_xor.at(query[k], at // 8, (1 << at % 8).astype(np.uint8))
    index = code_search.SubstringIndex(code)
    far = np.bitwise_count(query[:, None] ^ code[None]).sum(2)
    for r in (0, 10, 15, 16, 40, 47, 48, 64, 90, 120, 256):
        assert (index.within(query, r) == (far <= r)).all()
    parts = np.bitwise_count(query.view(np.uint16)[:, None] ^ code.view(np.uint16)[None]).min(2)
    for reach in (0, 1, 2):
        assert (index.probed(query, reach) == (parts <= reach)).all()


# -- filter audit ------------------------------------------------------------------------------------

def plain_audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    words = lambda t: [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
    says = {}
    for i, q, t in labels:
        a, b = says.get(i, (False, False))
        says[i] = (a or q == 1, b or t == 1)
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = words(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (o or "") == t for j, o, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, *(says.get(i, (False, False)) if i is not None else (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        of_part, removals = [r for r in rows if r[0] == part], Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = of_part
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in of_part)
                removals[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in of_part),
                              sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], removals[s[-1]]) for s in steps]
    return Counter(out)


def test_audit_of_odd_rows(spark):
    rng = random.Random(9)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", "a b", long, long + "\t\fA", "same " * 300, "SAME " * 300, long.upper(), long + " #", "\v\r", "ü" * 400, "x y | " * 90, "😀 A" * 250]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(90)] + [(99, long, "clean"), (2, "a", "one")]
    labels = [(rng.choice([None, *range(25)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(30)]
    frame = spark.createDataFrame([(i, t, s, 1, "m", 2, True) for i, t, s in docs], "doc_id long, text string, source string, mask int, part string, n int, q boolean")
    got = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS))
    assert Counter(tuple(r) for r in got.collect()) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_shapley_weights_are_those_of_all_orders():
    want = np.zeros((5, 32), int)
    for order in permutations(range(5)):
        s = 0
        for f in order:
            want[f, s | 1 << f] += 1
            want[f, s] -= 1
            s |= 1 << f
    assert np.array(filter_audit.shapley_weights()).tolist() == want.tolist()
