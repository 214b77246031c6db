"""N-gram Jaccard join: a MinHash LSH forest proposes, exact set comparison decides.

Words are lower-cased (A-Z) runs of 0-9, a-z and bytes from 0x80; a document is
the set of its runs of five words (all its words, when it has fewer).

Plan. (1) Every document becomes a keyed hash of its whole set and a signature:
``TREES`` rows of min-hashes, sixteen bits a level, of up to ``DEPTH`` levels. Documents with equal sets are one class,
aggregated before the shuffle; classes go on under a number of their own. (2) The signature of a tree is a path in
its prefix trie; a node is the classes that have its prefix. Two sets of similarity s have a prefix of k levels
in common with probability s ** k in a tree. A class begins with whole paths and gives up one level after the
other until its partners, at the smallest similarity at or over the threshold that any set can have with one of its
size, meet it in some tree with the target recall (``prefix_length``): short sets stop at longer prefixes, and sets too small to
have a different partner stay out. A node counts if it has two classes, one of which stops at its level. (3) A class lives
at the fullest of its nodes; the classes of a home are cut by hash into blocks of a bounded number
of classes and shingles. Two blocks are compared as a tile if some node has classes of both, and every block with itself, so
all pairs that meet are in exactly one tile, and pages that are merely chained over others are not compared. (4) The sets
of a block are read again from the texts and packed into one row, in which a shingle that several of them have stands once; a tile
is dealt its two blocks and multiplies their incidence matrices, which gives exact intersections; it
returns each class's links and a spanning forest. (5) Components of the links are the groups.

Nodes are told apart by a hash; two that clash only add pairs that the exact comparison turns down.

Defined cases: a null text, or one without a word, links with nothing; repeated rows and texts
of equal sets link with each other; rows with a null id are dropped; rows of one id with different
sets are documents of their own, all compared, and of a group's rows with the smallest id the one with the smallest digest
of its text is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.llm.components import connected, roots, runs
from spogrid.llm.shared import bounded_batches, few, stored
from spogrid.llm.textkit import LOWER, WORD, byte_view, chunks, mix, span_keys, word_spans

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.999995
BLOCK = 256
# Shingles of a block's sets together.
BLOCK_SHINGLES = 1 << 18
CHUNK = 1 << 20
# Sets of fewer shingles have a prefix length of their own.
SMALL = 32
# Shingles of the tiles of a task, about.
TASK_SHINGLES = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def smallest_similarity(n: int, threshold: float) -> float | None:
    """The smallest similarity at or over the threshold of a set of n and a different one; None if there is none."""
    t = Fraction(str(threshold))
    found = []
    for m in range(max(1, ceil(t * n)), int(n / t) + 1):
        common = ceil(t * (n + m) / (1 + t))
        if common <= min(n, m) and not common == n == m:
            found.append(Fraction(common, n + m - common))
    return float(min(found)) if found else None


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Levels that are left when prefixes were shortened until sets of that similarity meet with the target recall."""
    k = depth
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


def prefix_lengths(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> list[int]:
    """The levels left for sets of 0, 1, 2, ... shingles (0: no different set can be so similar); the last one holds
    for all larger sets."""
    small = [smallest_similarity(n, threshold) if n else None for n in range(SMALL)]
    return [prefix_length(s, trees, depth, recall) if s else 0 for s in small] + [prefix_length(threshold, trees, depth, recall)]


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the text number of each."""
    data, off = byte_view(texts)
    data = LOWER[data]
    starts, ends, doc = word_spans(data, off, WORD)
    h = span_keys(data, starts, ends)
    first = np.searchsorted(starts, off)
    n = np.diff(first)
    long = np.repeat(n >= words, n)
    at = np.arange(len(h))
    # a window begins at each word that has enough words of its text behind it; a short text has one window
    begin = np.where(long, at + words <= first[doc + 1], at == first[doc]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(begin)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = at + k < first[doc[at] + 1]
        out = np.where(inside, mix(out * _STEP + h[np.minimum(at + k, max(len(h) - 1, 0))]), out) if len(h) else out
    who = doc[at]
    order = np.lexsort((out, who))
    out, who = out[order], who[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (who[1:] != who[:-1])
    return out[new], who[new]


def paths(sets: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """document x tree x level: sixteen bits of the smallest hash of each set (documents with a set)."""
    out = np.zeros((len(first), trees, depth), np.uint16)
    rng = np.random.default_rng(20_011)
    for t in range(trees):
        for k in range(depth):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            low = np.minimum.reduceat((sets ^ b) * (a | np.uint64(1)), first)
            # the low bits of a product are weak: what is smallest is told by the high ones, and mixed before use
            out[:, t, k] = mix(low) >> np.uint64(48)
    return out


def set_keys(sets: np.ndarray, who: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole set."""
    out = np.zeros((2, n_docs), np.uint64)
    has, first = np.unique(who, return_index=True)
    if len(has):
        for k, salt in enumerate((0x5BD1E995, 0x1B873593)):
            out[k, has] = np.add.reduceat(mix(sets ^ np.uint64(salt)), first)
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, digest, n, set_a, set_b, path) of the documents that have a word; path: the trees' paths, two bytes a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", CHUNK):
                sets, who = shingles(texts, words)
                has, first, n = np.unique(who, return_index=True, return_counts=True)
                if not len(has):
                    continue
                keys = [k[has] for k in set_keys(sets, who, len(texts))]
                path = paths(sets, first, trees, depth)
                path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * trees * depth), len(has), [None, pa.py_buffer(np.ascontiguousarray(path))]).cast(pa.binary())
                yield pa.record_batch(
                    [part.column("doc_id").take(pa.array(has)), part.column("digest").take(pa.array(has)), pa.array(n), *map(pa.array, keys), path],
                    ["doc_id", "digest", "n", "set_a", "set_b", "path"],
                )

    return docs.mapInArrow(run, "doc_id long, digest binary, n long, set_a long, set_b long, path binary")


def trie_places(classes: DataFrame, lengths: list[int], trees: int, depth: int) -> DataFrame:
    """(class, node, m) for each node that has m > 1 classes, one of which stops at its level.

    A class with a long prefix is also placed at the shorter ones at which others stop."""
    own = F.element_at(F.array(*map(F.lit, lengths)), F.least(F.col("n"), F.lit(len(lengths) - 1)).cast("int") + 1)
    levels = F.array(*map(F.lit, sorted({k for k in lengths if k})))
    places = classes.withColumn("own", own).where("own > 0")
    places = places.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("level", F.explode(F.filter(levels, lambda k: k <= F.col("own"))))
    prefix = F.substring("path", F.col("tree") * (2 * depth) + 1, F.col("level") * 2)
    places = places.select("class", F.xxhash64("tree", "level", prefix).alias("node"), (F.col("own") == F.col("level")).alias("stops"))
    nodes = places.groupBy("node").agg(F.count("*").alias("m"), F.max("stops").alias("stops")).where("m > 1 AND stops").drop("stops")
    return places.select("class", "node").join(stored(nodes, "trie-nodes"), "node")


def meeting_blocks(placed: DataFrame, members: DataFrame) -> DataFrame:
    """(lo, hi): every block with itself, and every two blocks of which some node has classes."""
    seen = placed.join(members.select(F.col("id").alias("class"), "block"), "class").select("node", "block").distinct()
    seen = stored(seen, "trie-blocks")
    # nodes with the same blocks say the same
    told = F.xxhash64("block")
    sets = seen.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(told).alias("x"), F.bit_xor(F.xxhash64(told)).alias("y")).where("n > 1")
    sets = stored(sets.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node"), "trie-meetings")
    seen = stored(seen.join(sets, "node"), "trie-meeting-blocks")
    pairs = seen.select("node", F.col("block").alias("lo")).join(seen.select("node", F.col("block").alias("hi")), "node").where("lo < hi").select("lo", "hi").distinct()
    itself = members.select(F.col("block").alias("lo"), F.col("block").alias("hi")).distinct()
    return stored(itself.unionByName(pairs), "tiles")


def tile_links(sets: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of lo, one of hi) with Jaccard similarity >= threshold, by exact counts."""
    n = np.array([len(s) for s in sets])
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    shared, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1  # what one set alone has meets nothing
    number = np.cumsum(times > 1) - 1
    column, who = number[column[keep]], who[keep]
    width = int((times > 1).sum())
    common = np.zeros((len(lo), len(hi)))
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    row_lo, row_hi = np.full(len(sets), -1), np.full(len(sets), -1)
    row_lo[lo], row_hi[hi] = np.arange(len(lo)), np.arange(len(hi))
    step = 4096
    for at in range(0, width, step):
        a, b = np.searchsorted(column, [at, at + step])
        x, y = np.zeros((len(lo), step), np.float32), np.zeros((len(hi), step), np.float32)
        for grid, row in ((x, row_lo), (y, row_hi)):
            r = row[who[a:b]]
            grid[r[r >= 0], column[a:b][r >= 0] - at] = 1
        common += x @ y.T
    union = n[lo][:, None] + n[hi] - common
    return np.nonzero((common > 0) & (common >= threshold * union - 1e-9 * union))


def _packed_block(rows: pa.Table) -> pa.RecordBatch:
    """One row for the sets of a block, each class once: a shingle that several sets have is kept once, the sets as numbers of shingles."""
    ids, first = np.unique(rows["id"].to_numpy(), return_index=True)
    raw = rows["sets"].take(pa.array(first)).combine_chunks()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
    known, columns = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *map(len, sets)], dtype=np.int64)
    whole = [ids, rows["size"].to_numpy()[first], columns.astype(np.uint32), starts, known]
    return pa.record_batch(
        [rows["block"].slice(0, 1).combine_chunks(), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in whole)],
        ["block", "ids", "sizes", "columns", "starts", "known"],
    )


def tile_blocks(blocks: DataFrame, sides: DataFrame) -> DataFrame:
    """The packed blocks of each tile: at most two rows a tile, however many sets a block has."""
    return blocks.join(few(sides), "block")


def _unpacked(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, sizes, blocks, sets) of a tile's classes, in order of id; each of its blocks counts once."""
    found: dict[int, tuple] = {}
    for row in tile.select(["block", "ids", "sizes", "columns", "starts", "known"]).to_pylist():
        if row["block"] not in found:
            ids, sizes, starts = (np.frombuffer(row[c], np.int64) for c in ("ids", "sizes", "starts"))
            flat = np.frombuffer(row["known"], np.uint64)[np.frombuffer(row["columns"], np.uint32)]
            found[row["block"]] = ids, sizes, np.full(len(ids), row["block"]), np.split(flat, starts[1:-1])
    ids, sizes, home = (np.concatenate([x[k] for x in found.values()]) for k in range(3))
    sets = [one for x in found.values() for one in x[3]]
    order = np.argsort(ids, kind="stable")
    return ids[order], sizes[order], home[order], [sets[k] for k in order.tolist()]


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH,
                    recall: float = RECALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, component_id, n_links, kept): the smallest id of the same set, the smallest id
    reachable by links, the number of other documents linked directly, and whether the document stands for its group."""
    return _grouped(docs, threshold, words, trees, depth, recall, block, id_col, text_col).drop("digest")


def _grouped(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
             block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates() with the digest of each text."""
    spark = docs.sparkSession
    bounded_batches(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = prefix_lengths(threshold, trees, depth, recall)
    depth = max(lengths)  # no class stops at a longer prefix
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    texts = texts.withColumn("digest", _digest(F.col("text")))
    signed = stored(signatures(texts, words, trees, depth), "shingle-signatures")
    same = ["n", "set_a", "set_b"]
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    classes = signed.groupBy(*same).agg(first, F.count("*").alias("size"), F.first("path").alias("path"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "shingle-classes")
    placed = stored(trie_places(classes, lengths, trees, depth), "trie-places")
    homes = placed.groupBy("class").agg(F.max(F.struct("m", "node")).getField("node").alias("home"))
    members = classes.select("class", F.col("first.doc_id").alias("doc_id"), "size", *same).join(homes, "class").withColumnRenamed("class", "id")
    members = stored(members, "trie-homes")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    members = members.join(stored(members.groupBy("home").agg(blocks), "home-sizes"), "home")
    members = stored(members.select("id", "doc_id", "size", *same, F.xxhash64("home", F.pmod(F.xxhash64("id"), "blocks")).alias("block")), "trie-members")
    tiles = meeting_blocks(placed, members)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in chunks(batch, "text", CHUNK):
                sets, who = shingles(some, words)
                cut = np.searchsorted(who, np.arange(len(some) + 1))
                raw = pa.array([sets[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
                a, b = set_keys(sets, who, len(some))  # an id may have other texts too
                own = pa.array((a == part.column("set_a").to_numpy()) & (b == part.column("set_b").to_numpy()))
                names = ["id", "size", "block"]
                yield pa.record_batch([*(part.column(c) for c in names), raw], [*names, "sets"]).filter(own)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["block"]):
            yield _packed_block(rows)

    # while they are few, the texts stay where they are
    one = texts.join(few(members), "doc_id").select("id", "size", "block", "set_a", "set_b", "text")
    with_sets = one.mapInArrow(sets_of, "id long, size long, block long, sets binary")
    # a row for each block: what is dealt to a tile are its two blocks, not their sets one by one
    blocks = with_sets.repartition(partitions, "block").sortWithinPartitions("block", "id")
    blocks = blocks.mapInArrow(packed, "block long, ids binary, sizes binary, columns binary, starts binary, known binary")
    sides = tiles.select(F.col("lo").alias("block"), "lo", "hi").unionByName(tiles.where("lo < hi").select(F.col("hi").alias("block"), "lo", "hi"))
    keys = ["lo", "hi"]
    sides = stored(sides, "tile-sides")
    total = sides.join(members.groupBy("block").agg(F.sum("n").alias("n")), "block").agg(F.sum("n")).first()[0]
    tasks = max(partitions, (total or 0) // TASK_SHINGLES)
    dealt = tile_blocks(blocks, sides).repartition(tasks, *keys).sortWithinPartitions(*keys, "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, keys):
            lo, hi = tile["lo"][0].as_py(), tile["hi"][0].as_py()
            if len(set(tile["block"].to_pylist())) < len({lo, hi}):
                continue  # a block without sets
            ids, size, home, sets = _unpacked(tile)
            a, b = np.flatnonzero(home == lo), np.flatnonzero(home == hi)
            i, j = tile_links(sets, a, b, threshold)
            i, j = a[i], b[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, i, size[j])
            np.add.at(count, j, size[i])
            root = ids[roots(len(ids), i, j)]  # rows are in order of id
            some = np.flatnonzero(count)
            if len(some):
                yield pa.record_batch([pa.array(ids[some]), pa.array(root[some]), pa.array(count[some])], ["id", "root", "n"])

    links = stored(dealt.mapInArrow(compare, "id long, root long, n long"), "shingle-links")
    groups = stored(connected(links.select(F.col("id").alias("a"), F.col("root").alias("b"))), "shingle-groups")
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    linked = classes.select(F.col("class").alias("id"), "first", "size", *same).join(groups, "id").join(counts, "id")
    linked = stored(linked, "shingle-linked")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").select(*same, "head", "n_links")
    known = classes.select(*same, "first", "size").join(linked, same, "left")
    known = stored(known.select(*same, "first", F.coalesce("head", "first").alias("head"), (F.col("size") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")), "shingle-answers")
    found = signed.select("doc_id", "digest", *same).join(known, same)
    kept = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("digest") == F.col("head.digest"))
    found = found.select("doc_id", F.col("first.doc_id").alias("class_id"), F.col("head.doc_id").alias("component_id"), "n_links", kept.alias("kept"), "digest")
    return _with_wordless(texts, found)


def _digest(text: Column) -> Column:
    """SHA-256 of a text; a null one has that of none."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _with_wordless(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Documents without a word stand for themselves."""
    bare = texts.where(~F.coalesce(F.col("text"), F.lit("")).rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"))
    itself = F.col("doc_id")
    bare = bare.select(itself, itself.alias("class_id"), itself.alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "digest")
    return found.unionByName(bare)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns: of rows with the same id and text one stays;
    rows of one id with different texts are told apart; rows with a null id, or whose text has no word, stay."""
    found = stored(_grouped(docs, id_col=id_col, text_col=text_col), "shingle-groups")
    gone = stored(found.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "shingle-gone")
    text = F.col(text_col).cast("string")
    out = docs.join(few(gone), (F.col(id_col).cast("long") == F.col("__id")) & (_digest(text) == F.col("__digest")), "left_anti")
    rows, ids = found.where("kept").agg(F.count("*"), F.countDistinct("doc_id", "digest")).first()
    if rows > ids:  # repeated rows
        out = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))
    return out.select(*docs.columns)
