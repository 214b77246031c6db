"""Similarity operators, classifier, decontamination and the pipeline, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import public_tokenizers
from pyspark.sql import functions as F

from spogrid.llm import bpe, components, embedding_dedup, quality, queries, shingle_join, stages, template_decontam

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, id long, h int, n int, t string, shift int"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "s", -k, k, 1, "t", 2) for k, t in enumerate(texts)], SCHEMA)


def groups_of(n, links):
    """Smallest member of each number's group."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# -- components --------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(30)] + [(rng.randrange(40, 120), rng.randrange(40, 120)) for _ in range(60)] + [(200, k) for k in range(201, 260)]
    got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups_of(300, links)
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array(links).T
    assert components.roots(300, a, b).tolist() == want


def test_runs():
    batches = [pa.record_batch([pa.array(x)], ["k"]) for x in ([1, 1, 2], [], [2, 2], [3], [3, 4])]
    assert [t["k"].to_pylist() for t in components.runs(iter(batches), ["k"])] == [[1, 1], [2, 2, 2], [3, 3], [4]]


# -- embeddings --------------------------------------------------------------------------------------

def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 24)), rng.normal(size=(20, 24)) ** 5, np.eye(24)[:8] * 1e-30])
    unit, q, scale, error = embedding_dedup.quantise(x)
    approx = (q.astype(float) @ q.astype(float).T) * scale[:, None] * scale
    assert (np.abs(unit @ unit.T - approx) <= error[:, None] + (1 + error[:, None]) * error + 1e-12).all()
    i, j = embedding_dedup.tile_links(x, x, 0.5)
    exact = (x @ x.T) / np.sqrt(np.outer((x**2).sum(1), (x**2).sum(1)))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(exact >= 0.5)), strict=True))


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    rows = []
    for k in range(120):
        v = base[k % 6] + rng.normal(size=16) * 0.09 * (k % 4)
        rows.append((k, v.tolist(), k % 3 if k % 11 else None, "x", k))
    rows += [(200 + k, rows[7][1], 1, "x", k) for k in range(40)]  # copies
    rows += [(300, None, 1, "x", 0), (301, [0.0] * 16, 1, "x", 0), (302, [float("nan")] * 16, 1, "x", 0), (303, [None, *rows[7][1][1:]], 1, "x", 0),
             (304, [float("inf"), *rows[7][1][1:]], 1, "x", 0), (305, [], 1, "x", 0), (306, rows[7][1][:8], 1, "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string, size int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=16).collect()}
    good = [(i, np.array(v), lab) for i, v, lab, *_ in rows if i < 300 and lab is not None]
    links = [(a, b) for a, x, p in good for b, y, q in good if a < b and p == q and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98]
    want = groups_of(400, links)
    assert len(got) == len(rows)
    for i, *_ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in p for p in links), want[i], want[i] == i)
    assert any(want[i] != i and got[i]["class_id"] == i for i in range(120))  # links between different vectors
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# -- shingles ----------------------------------------------------------------------------------------

def words_of(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def set_of(t):
    w = words_of(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def copies(seed=11):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=55))
    texts = [None, "", "...", "one two", "One, TWO!", "one two three four", "a b c d e f"]
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 30, 120]))
        for _ in range(rng.choice([1, 2, 9])):
            near = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near) if g % 3 else passage + "\n" + " ".join(near))
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = copies()
    sets = [set_of(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups_of(len(texts), links)
    found = shingle_join.near_duplicates(frame(spark, texts), block=3)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(texts) and found.columns == ["doc_id", "class_id", "component_id", "n_links", "kept"]
    for k in range(len(texts)):
        same = min([k, *(j for j in range(len(sets)) if sets[k] and sets[j] == sets[k])])
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["class_id"]) == (sum(k in p for p in links), want[k], same), k
    assert any(got[k]["class_id"] == k != want[k] for k in range(len(texts)))
    docs = frame(spark, texts)
    kept = shingle_join.one_of_each(docs.unionByName(docs.limit(20)))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if want[k] == k]
    assert shingle_join.near_duplicates(docs.limit(0)).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    meets = lambda s, k: 1 - (1 - s**k) ** shingle_join.TREES
    lengths = shingle_join.prefix_lengths(0.8)
    for n in range(1, 60):
        could = [c / (n + m - c) for m in range(1, 100) for c in range(1, min(n, m) + 1) if 5 * c >= 4 * (n + m - c) and not c == n == m]
        least = shingle_join.smallest_similarity(n, 0.8)
        assert least == (pytest.approx(min(could)) if could else None), n
        k = lengths[min(n, len(lengths) - 1)]
        assert (k == 0) == (not could)
        if could:
            assert meets(least, k) >= shingle_join.RECALL, n
            assert n >= shingle_join.SMALL or meets(least, k + 1) < shingle_join.RECALL, n
    assert len(set(lengths)) > 2
    assert max(shingle_join.prefix_lengths(0.95)) == shingle_join.DEPTH > max(lengths)


def test_recall_of_the_forest(spark):
    """Pairs from 0.8 to 0.9 meet in the forest; those at 0.3 mostly do not."""
    rng = random.Random(3)
    texts, high, low = [], [], []
    for g in range(150):
        base = ["g%dw%d" % (g, k) for k in range(84)]
        cut = rng.choice([2, 4, 6, 8])
        texts += [" ".join(base), " ".join(base[cut:] + ["g%dx%d" % (g, k) for k in range(cut)]), " ".join(base[45:] + ["g%dy%d" % (g, k) for k in range(45)])]
        sets = [set_of(t) for t in texts[-3:]]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) and len(sets[0] & sets[2]) < 0.35 * len(sets[0] | sets[2])
        high.append((3 * g, 3 * g + 1))
        low.append((3 * g, 3 * g + 2))
    lengths = shingle_join.prefix_lengths(0.8)
    signed = shingle_join.signatures(frame(spark, texts).withColumn("digest", shingle_join._digest(F.col("text"))), 5, shingle_join.TREES, max(lengths))
    placed = shingle_join.trie_places(signed.withColumn("class", F.col("doc_id")), lengths, shingle_join.TREES, max(lengths))
    at = {}
    for r in placed.collect():
        at.setdefault(r["class"], set()).add(r["node"])
    met = lambda pairs: sum(bool(at.get(a, set()) & at.get(b, set())) for a, b in pairs)
    assert met(high) == 150 and met(low) < 75


def test_a_chain_is_not_compared_whole(spark, monkeypatch):
    n, step = 160, 20
    words = ["w%d" % k for k in range(step * n + 100)]
    texts = [" ".join(words[step * k : step * k + 100]) for k in range(n)]  # neighbours at 0.66 meet, all hang together
    texts += [" ".join(words[step * k + 2 : step * k + 102]) for k in range(0, n, 10)]
    seen = []
    meeting = shingle_join.meeting_blocks
    monkeypatch.setattr(shingle_join, "meeting_blocks", lambda *a: seen.append(meeting(*a)) or seen[-1])
    got = {r["doc_id"]: r for r in shingle_join.near_duplicates(frame(spark, texts), block=4).collect()}
    tiles = seen[0].count()
    blocks = seen[0].where("lo = hi").count()
    assert blocks >= len(texts) / 4 and tiles < 6 * blocks < blocks * (blocks - 1) / 2
    for j in range(n // 10):
        assert got[n + j]["n_links"] == 1 and got[n + j]["component_id"] == 10 * j
    assert sum(r["n_links"] for r in got.values()) == 2 * (n // 10)


def test_a_large_group_is_dealt_by_blocks(spark, monkeypatch):
    """Sets of near copies are not joined one by one with every tile of their block."""
    base = ["w%d" % k for k in range(200)]
    texts = [" ".join(["x%d" % k, *base[1:]]) for k in range(60)]
    seen, joined = [], shingle_join.tile_blocks
    monkeypatch.setattr(shingle_join, "tile_blocks", lambda *a: seen.append((*a, joined(*a))) or seen[-1][-1])
    got = shingle_join.near_duplicates(frame(spark, texts), block=4).collect()
    assert all(r["n_links"] == 59 and r["component_id"] == 0 for r in got) and len(got) == 60
    (blocks, sides, dealt), = seen
    n, tiles = blocks.count(), sides.select("lo", "hi").distinct().count()
    assert 15 <= n < 30 and tiles == n * (n + 1) // 2 and dealt.count() == sides.count() == n * n


def test_packed_blocks_hold_every_set():
    sets = {7: [1, 5, 9], 3: [5], 9: [1, 2, 5, 9]}
    raw = [np.array(x, np.uint64).tobytes() for x in sets.values()]
    table = pa.table({"id": [*sets, 7], "size": [2, 1, 4, 2], "block": [6] * 4, "sets": pa.array([*raw, raw[0]], pa.binary())})
    other = pa.table({"id": [8], "size": [1], "block": [5], "sets": pa.array([raw[0]], pa.binary())})
    packed = pa.Table.from_batches([shingle_join._packed_block(table), shingle_join._packed_block(other)])
    ids, sizes, home, found = shingle_join._unpacked(packed)
    assert ids.tolist() == [3, 7, 8, 9] and sizes.tolist() == [1, 2, 1, 4] and home.tolist() == [6, 6, 5, 6]
    assert [x.tolist() for x in found] == [sets[3], sets[7], sets[7], sets[9]]


def test_shingle_hashes_tell_sets_apart():
    texts = copies() + ["a b c d", "a b c d e", "b a c d"]
    sets, who = shingle_join.shingles(pa.array([t or "" for t in texts], pa.large_string()))
    mine = [frozenset(sets[who == k].tolist()) for k in range(len(texts))]
    plain = [set_of(t) for t in texts]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(mine[a] & mine[b]) == len(plain[a] & plain[b])


# -- decontamination ---------------------------------------------------------------------------------

ITEM = "A train leaves Boston at 9:30 and travels 60 miles in 2 hours, while another train leaves Chicago and covers 60 miles in 3 hours. How fast is it?"
PLAIN = "the quick brown fox jumps over the lazy dog while nobody in the whole wide garden looks at it"


def test_templates(spark):
    swap = lambda t, *pairs: [t := t.replace(a, b) for a, b in pairs][-1]
    filler = "Nothing of this kind stands here at all. "
    texts = [
        None, "", "one two", filler * 3,
        filler + ITEM + " " + filler,  # 4: as it is
        filler + swap(ITEM, ("Boston", "Dallas"), ("Chicago", "Denver"), ("60", "75"), ("9:30", "8:15"), (" 2 ", " 4 "), (" 3 ", " 5 ")),  # 5: with new values
        filler + ITEM.replace("60", "75", 1),  # 6: one 60 stands for two numbers: another question
        PLAIN.upper(), PLAIN + ".", "x " * 4000 + PLAIN,  # 7: other case is the same template; 8, 9
        " ".join(PLAIN.split()[:8]),  # 10: too little of it
        " ".join(PLAIN.split()[:14]) + " and so on",  # 11: a long run
        PLAIN.replace("lazy", "very lazy"),  # 12: an inserted word breaks windows
    ]
    docs = frame(spark, texts)
    items = spark.createDataFrame([(1, ITEM), (2, PLAIN), (3, "too short"), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in template_decontam.contaminated(docs, items).collect()}
    assert sorted(found) == [(4, 1), (5, 1), (7, 2), (8, 2), (9, 2), (11, 2)]
    assert found[4, 1]["changed"] == 0 and found[5, 1]["changed"] >= 6 and found[9, 2]["shift"] == 4000
    left = template_decontam.decontaminate(docs.unionByName(docs.limit(2)), items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 0, 1, 1, 2, 3, 6, 10, 12]
    assert template_decontam.contaminated(docs.limit(0), items).count() == 0
    assert template_decontam.contaminated(docs, items.limit(0)).count() == 0
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", items.toArrow())
    assert sorted(r[:2] for r in con.execute(template_decontam.sql()).fetchall()) == sorted(found)


def found_by(spark, texts, items):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in template_decontam.contaminated(frame(spark, texts), items).collect()}


def test_slots_are_read_where_windows_match(spark):
    item = ("we know that Boston lies on the coast and has a very old harbour with many ships, and ships from Boston sail on to Lisbon "
            "while others go from 12 piers to 7 small islands each day in the summer")  # fmt: skip
    words = item.split()
    texts = [
        " ".join(words[:20]) + ". Nothing else of it stands here, and you read Paris there",  # 0: the run alone, Boston stands outside it too
        item.replace("and ships", "and some ships"),  # 1: an inserted word moves the slots behind it
        item.replace("and ships", "ships"),  # 2: a missing one
        item.replace("Boston", "Bergen", 1) + " . . " + item,  # 3: another question, and after it the item
        item.replace("Boston", "Bergen", 1),  # 4: the other question alone
    ]
    assert sorted(found_by(spark, texts, [item])) == [(k, 0) for k in range(4)]


def test_items_of_slots_and_short_items(spark):
    numbers = "3 14 15 92 65 35 89 79 32 38 46 26"
    units = "Convert 5 km 20 miles 7 feet 300 inches 12 yards"
    names = "Boston Chicago Denver Dallas Paris Lisbon"
    mixed = "add 17 and 25 then 31 and 47 now take 8 of 90 from 12 and 6 as 77 is 54 more than 23"
    texts = [
        f"so {numbers} it is", f"please: {units}.", f"he went to {names} too", "nothing " + mixed + " else",
        " ".join(mixed.split()[4:20]),  # 4: a long passage, with numbers all through it
        " ".join(str(k) for k in range(200, 230)), "We saw Rome Madrid Vienna Berlin Prague Warsaw Athens",  # 5, 6: placeholders alone
        "what is 7 x 8?", "what is 9 x 8?", "7 8", "Is it over there",
    ]
    found = found_by(spark, texts, [numbers, units, names, mixed, "7 x 8", "Over There!"])
    assert sorted(found) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (7, 4), (10, 5)]
    assert found[4, 3]["run"] == 12 and found[7, 4]["shift"] == 2


def test_items_with_an_edited_word(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    items = [[word() for _ in range(n)] for n in (10, 15, 16, 19, 22, 26, 30)]
    items[3][5:12] = ["Boston", "with", "12", "other", "towns", "but", "12"]
    texts, want = [], set()

    def add(k, words, found=True):
        if found:
            want.add((len(texts), k))
        texts.append(" ".join([word(), word(), *words, word()]))

    for k, item in enumerate(items):
        for p in range(len(item)):
            if item[p].islower():
                add(k, [*item[:p], word(), *item[p + 1 :]])
                add(k, item[:p] + item[p + 1 :])
    add(4, [*items[4][:7], word(), *items[4][8:14], word(), *items[4][15:]])
    add(1, [*items[1][:5], word(), word(), *items[1][7:]], False)
    add(0, [word() for _ in range(4)] + items[0][4:], False)  # half of it
    add(3, [word() if w == "other" else "13" if i == 11 else w for i, w in enumerate(items[3])], False)  # another question
    add(3, [word() if w == "other" else "13" if w == "12" else w for w in items[3]])
    assert sorted(found_by(spark, texts, [" ".join(i) for i in items])) == sorted(want)


def test_decontamination_runs_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = template_decontam.decontaminate(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


# -- quality -----------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op1_quality(spark, folder).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    # probabilities mean what they say
    assert np.mean([r["score"] for r in got]) == pytest.approx(np.mean([r["quality"] for r in got]), abs=0.03)


def test_quality_odd_input(spark):
    texts = [None, "", " \n", "x", "word " * 5000, "%%% &&& ***", "The cat sat. " * 3]
    docs = frame(spark, [*texts, *("good words here number %d stand in a row" % k for k in range(20)), *("bad bad bad bad %%% " * (k + 1) for k in range(20))])
    rows = [(k, int(7 <= k < 27)) for k in range(7, 47)] + [(1, None), (None, 1), (8, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[k]["predicted"] == y for k, y in rows[:40]]) == 1
    assert got[0]["score"] == got[1]["score"] == got[2]["score"]
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["predicted"]}
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert {r["predicted"] for r in quality.score(docs, one).collect()} == {1}
    assert quality.score(docs.limit(0), model).count() == 0


def test_context_sums():
    index = np.eye(5, dtype=np.float32)
    got = quality.context_sums(np.array([0, 1, 2, 0, 3]), np.array([0, 0, 0, 0, 1]), index)
    want = np.zeros((5, 6))
    tokens = [(0, 0), (1, 0), (2, 0), (0, 0), (3, 1)]
    for i, (a, d) in enumerate(tokens):
        want[a, -1] += 1
        for j, (b, e) in enumerate(tokens):
            if i != j and abs(i - j) <= 2 and d == e:
                want[a, b] += 1
    assert (got == want).all()


# -- pipeline ----------------------------------------------------------------------------------------

def test_stages(spark):
    """Each stage over what the one before kept: columns stay, and its decisions are those of its operator."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    before, texts = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.columns == docs.columns and after.exceptAll(before).count() == 0
        texts[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in after.collect()})
        before = after
    was, left = texts["near_duplicates"]
    ids = sorted(was)
    sets = [set_of(was[k]) for k in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(left) == [ids[k] for k, g in enumerate(groups_of(len(ids), links)) if g == k]
    was, left = texts["decontamination"]
    items = [" ".join(w.decode() for w in words_of(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {k for k, t in was.items() if any(i in " ".join(w.decode() for w in words_of(t)) for i in items)}
    assert set(was) - set(left) == held
    encoded = stages.byte_bpe(spark, before, SMALL).collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in encoded} == {k: encoding.encode_ordinary(t) for k, t in left.items()}
    assert corpus_pipeline.run(spark, SMALL).count() == len(left)


def test_stages_on_nothing_and_nulls(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        stage(spark, docs.limit(30).unionByName(odd).unionByName(odd), SMALL).collect()


# -- several rows under one id -----------------------------------------------------------------------

WORDS_A = " ".join(f"alpha{k}" for k in range(40))
WORDS_B = " ".join(f"beta{k}" for k in range(40))


def with_ids(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, k, 2, "t", 3) for k, (i, t) in enumerate(rows)], SCHEMA)


def test_texts_under_one_id_are_documents_of_their_own(spark):
    docs = with_ids(spark, [(1, WORDS_A), (2, WORDS_A), (2, WORDS_B)])
    assert sorted((r["doc_id"], r["text"]) for r in shingle_join.one_of_each(docs).collect()) == [(1, WORDS_A), (2, WORDS_B)]
    near_a, near_b = WORDS_A + " more", WORDS_B + " more"
    found = shingle_join.near_duplicates(with_ids(spark, [(1, WORDS_A), (1, WORDS_B), (2, near_a), (3, near_b)]))
    assert sorted((r["doc_id"], r["component_id"], r["n_links"], r["kept"]) for r in found.collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    # near copies under one id: one of them stays
    assert shingle_join.one_of_each(with_ids(spark, [(1, WORDS_A), (1, near_a), (4, WORDS_A), (4, WORDS_A)])).count() == 1
    assert shingle_join.one_of_each(with_ids(spark, [(4, WORDS_A), (4, WORDS_A), (None, WORDS_A), (5, ""), (5, None)])).count() == 4


def test_words_of_equal_polynomial_hashes_are_told_apart(spark):
    w = "a"
    for _ in range(11):
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    found = shingle_join.near_duplicates(with_ids(spark, [(1, w), (2, other), (3, w)]))
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_every_text_of_an_item_is_searched(spark):
    one = "which of the seven rivers named below carries the most water to the sea in spring"
    two = "how would you prove that the sum of two odd numbers is always an even number"
    bench = spark.createDataFrame([(1, one), (1, two), (2, "yes"), (2, None)], "item_id long, text string")
    docs = with_ids(spark, [(1, f"before {one} after"), (2, f"before {two} after"), (3, "I said yes and went home early"), (4, "well\nYes\nno"), (5, "nothing")])
    assert sorted(tuple(r) for r in template_decontam.contaminated(docs, bench).select("doc_id", "item_id", "short").collect()) == [(1, 1, False), (2, 1, False), (3, 2, True), (4, 2, True)]
    assert sorted(r["doc_id"] for r in template_decontam.decontaminate(docs, bench).collect()) == [3, 5]


def test_links_of_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 1.0])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept").collect()
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True), (7, 0, 7, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_contradictory_labels_teach_nothing(spark):
    docs = with_ids(spark, [(k, (WORDS_A if k % 2 else WORDS_B) + f" w{k}") for k in range(60)] + [(3, "another text"), (3, None)])
    labels = [(k, k % 2) for k in range(60)]
    frame_of = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    plain = quality.fit(docs, frame_of([x for x in labels if x[0] != 7]), F.lit(True))
    both = quality.fit(docs, frame_of([*labels, (7, 0), (7, 1), (None, 1), (9, None)]), F.lit(True))
    assert plain.temperature == both.temperature
    assert all((a == b).all() for a, b in zip(plain.weights, both.weights, strict=True))
