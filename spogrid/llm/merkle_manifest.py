"""Merkle manifest of a table: digests of rows, of sources and of the whole, with a proof for every row.

Plan. (1) A leaf is the SHA-256 of a row's fields, each with its length. (2) Where a
leaf stands in its source is asked of a bitmap index instead of a sort: the
ids of a source fall into containers of 32,768 consecutive numbers; partial
bitmaps are merged for each container (containers of few ids keep the ids
themselves, which is shorter), and a directory holds the rows before each
container. The rank of an id is its directory entry and the bits set before it. A
source of any size is spread over its containers, and the directory itself
is summed by range partitions. (3) Ranks are coordinates: leaf r is in slot
r mod 729 of block r div 729, and a block's array of slots is reduced by six
levels of three at once; the blocks' digests are the next step's leaves,
until one is left in each source. Steps are as many as the logarithm of the rows
to base 729. (4) Sources are numbered by range partitions and reduced alike to the root.
(5) From the top down each block hands to its slots the siblings on the way
up; what a leaf needs is then at hand without a join for each level, and its proof is folded anew.

Defined cases: null fields count as ``-``; a null source is its own, and the first; rows with a null
doc_id come first in their source; rows with one doc_id are ordered by their leaf, and
equal rows have neighbouring leaves; a null text stays null when tampered with; an empty
table gives no rows; only the columns named as fields are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spogrid.llm.shared import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 3, 6
BLOCK = FANOUT**LEVELS
# Ids of a container (as many bits as Spark's bitmap functions hold), and up to how many of them are kept as numbers.
BITS, SPARSE = 15, 256
# The container of rows without an id: before all others.
NO_ID = -(1 << 62)


def digest(fields: Sequence[Column]) -> Column:
    """H of values: each as ``-`` if null, else its bytes' number, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def source_key(source: Column) -> Column:
    """A string for each source, the null one too, in the order of sources."""
    return F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit("-"))


def before(rows: DataFrame, group: str, order: str, value: str, alias: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their ``group`` that come before them by
    ``order`` (unique in a group). Dealt by range and summed within partitions, upon the totals of the
    partitions before: a group of any size is spread."""
    dealt = stored(rows.repartitionByRange(group, order).withColumn("part", F.spark_partition_id()), "ranges")
    unbounded = (Window.unboundedPreceding, -1)
    totals = dealt.groupBy(group, "part").agg(F.sum(value).alias("n"))
    parts_before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(*unbounded))
    totals = totals.select(group, "part", F.coalesce(parts_before, F.lit(0)).alias("of_parts"))
    of_rows = F.sum(value).over(Window.partitionBy("part", group).orderBy(order).rowsBetween(*unbounded))
    out = dealt.withColumn("of_rows", F.coalesce(of_rows, F.lit(0))).join(totals, [group, "part"])
    return out.withColumn(alias, F.col("of_parts") + F.col("of_rows")).drop("part", "of_parts", "of_rows")


def containers(rows: DataFrame) -> DataFrame:
    """The index of (key, c, p): for each container its rows, its ids as positions or as a bitmap, and ``base``,
    the rows of the source in smaller containers."""
    counts = rows.groupBy("key", "c", "p").agg(F.count(F.lit(1)).alias("n"))
    sparse = counts.groupBy("key", "c").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"),
        F.bitmap_construct_agg(F.col("p").cast("long")).alias("bits"),
        # rows beyond the first of repeated ids, by position
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("p", (F.col("n") - 1).alias("more"))))).alias("repeated"),
        F.collect_list("p").alias("positions"),
    )
    few = F.col("ids") <= SPARSE
    held = sparse.withColumn("positions", F.when(few, F.col("positions"))).withColumn("bits", F.when(~few, F.col("bits")))
    return before(held, "key", "c", "rows", "base")


def rank_below() -> Column:
    """Rows of the container with a smaller position than ``p``."""
    whole = F.expr("bitmap_count(substring(bits, 1, p div 8))")
    byte = F.expr("conv(hex(substring(bits, p div 8 + 1, 1)), 16, 10)").cast("int")
    partial = F.bit_count(byte.bitwiseAND(F.expr("shiftleft(1, p % 8) - 1")))
    listed = F.size(F.filter("positions", lambda x: x < F.col("p"))).cast("long")
    more = F.aggregate(F.filter("repeated", lambda x: x["p"] < F.col("p")), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    return F.when(F.col("bits").isNull(), listed).otherwise(whole + partial) + more


def ranked(leaves: DataFrame) -> DataFrame:
    """Leaves (key, doc_id, leaf, c, p, row) with ``rank``, their place in the source."""
    index = stored(containers(leaves), "bitmap-index")
    out = leaves.join(index.withColumn("has_repeats", F.size("repeated") > 0), ["key", "c"])
    out = out.withColumn("rank", F.col("base") + rank_below())
    out = out.withColumn("twins", F.col("has_repeats") & F.exists("repeated", lambda x: x["p"] == F.col("p")))
    out = out.drop("bits", "positions", "repeated", "base", "rows", "ids", "has_repeats", "c", "p")
    if index.where(F.size("repeated") > 0).isEmpty():
        return out.drop("twins", "row")
    out = stored(out, "leaf-ranks")
    # Rows with one id: by leaf. Equal leaves are told apart by where they are stored; each step's group is a leaf or
    # what begins with the same digits, so no group of a hot id is a task.
    twins = out.where("twins").withColumn("digits", F.substring("leaf", 1, 3)).withColumn("stretch", F.shiftright("row", 33))
    same = ["key", "rank"]
    unbounded = (Window.unboundedPreceding, -1)
    sum_before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(*unbounded)), F.lit(0))
    parts = stored(twins.groupBy(*same, "digits", "leaf", "stretch").agg(F.count(F.lit(1)).alias("n")), "twins")
    a = parts.groupBy(*same, "digits").agg(F.sum("n").alias("n")).withColumn("a", sum_before(same, "digits")).drop("n")
    b = parts.groupBy(*same, "digits", "leaf").agg(F.sum("n").alias("n")).withColumn("b", sum_before([*same, "digits"], "leaf")).drop("n", "digits")
    c = parts.withColumn("s", sum_before([*same, "leaf"], "stretch")).drop("n")
    numbered = twins.withColumn("d", F.row_number().over(Window.partitionBy(*same, "leaf", "stretch").orderBy("row")) - 1)
    numbered = numbered.join(c, [*same, "digits", "leaf", "stretch"]).join(b, [*same, "leaf"]).join(a, [*same, "digits"])
    numbered = numbered.withColumn("rank", F.col("rank") + F.col("a") + F.col("b") + F.col("s") + F.col("d"))
    plain = out.where("NOT twins").drop("twins", "row")
    return plain.unionByName(numbered.select(*plain.columns))


def reduce_levels(slots: Column, levels: Column) -> Column:
    """Arrays of digests, level by level, from the slots up: as many runs of three as ``levels`` says."""

    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) + FANOUT - 1) / FANOUT).cast("int") - 1)
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))

    grown = F.array(slots)
    start = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(start, grown, lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row for each block of (key, rank, digest): its slots' items in order, the levels over them, and its digest."""
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    items = F.struct((F.col("rank") % BLOCK).cast("int").alias("slot"), "digest", *carried)
    held = nodes.groupBy("key", F.floor(F.col("rank") / BLOCK).cast("long").alias("block")).agg(F.array_sort(F.collect_list(items)).alias("items"))
    held = held.join(sizes, "key")
    # levels until one node is left in the whole source, six at most in this step
    height = sum((F.when(F.col("n") > FANOUT**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    held = held.withColumn("levels", reduce_levels(F.col("items")["digest"], height))
    return held.withColumn("digest", F.element_at(F.element_at("levels", -1), 1))


def tree(nodes: DataFrame, name: str, *carried: str) -> list[DataFrame]:
    """Steps of blocks from the leaves to one block for each key."""
    steps = [stored(blocks(nodes, *carried), name)]
    while not steps[-1].where("block > 0").isEmpty():
        up = steps[-1].select("key", F.col("block").alias("rank"), "digest")
        steps.append(stored(blocks(up), name))
    return steps


def siblings(levels: str, slot: str) -> Column:
    """The others of the run of a slot on each level, those before and those after it."""

    def at(i: Column) -> Column:
        place = F.floor(F.col(slot) / F.pow(F.lit(FANOUT), i)).cast("int")
        left = place % FANOUT
        level = F.col(levels)[i]
        return F.struct(
            F.array_join(F.slice(level, place - left + 1, left), "").alias("left"),
            F.array_join(F.slice(level, place + 2, FANOUT - 1 - left), "").alias("right"),
        )

    none = F.array().cast("array<struct<left:string,right:string>>")
    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), at)).otherwise(none)


def unfold(step: DataFrame, paths: DataFrame) -> DataFrame:
    """The items of each block with ``path``: the siblings within the block and then those that ``paths``
    has for (key, block); its other columns go along."""
    carried = [c for c in paths.columns if c not in ("key", "rank", "path")]
    rows = step.join(paths.withColumnRenamed("rank", "block").withColumnRenamed("path", "upper"), ["key", "block"])
    rows = rows.select("key", "block", "levels", "upper", *carried, F.explode("items").alias("item")).withColumn("slot", F.col("item.slot"))
    path = F.concat(siblings("levels", "slot"), F.col("upper"))
    return rows.select("key", (F.col("block") * BLOCK + F.col("slot")).alias("rank"), "item", path.alias("path"), *carried)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def proof(path: Column) -> Column:
    """H of all siblings, from the leaf to the root."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda a, s: F.concat(a, s["left"], s["right"])), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: Sequence[str] = FIELDS,
             tampered: Column | None = None) -> DataFrame:
    """(doc_id, source, rank, leaf, subroot, root, path, proof_sha256, folded_root, verified) for every row.

    ``tampered`` says whose line feeds are deleted from the text before the proof is checked.
    """
    doc_id = F.col(id_col).cast("long")
    values = [F.col(f) for f in fields]
    without = [F.replace(F.col(f).cast("string"), F.lit("\n"), F.lit("")) if f == text_col else F.col(f) for f in fields]
    shown = F.when(F.coalesce(tampered, F.lit(False)), digest(without)) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(
        source_key(F.col(source_col)).alias("key"), doc_id.alias("doc_id"), digest(values).alias("leaf"), shown.alias("shown"),
        F.coalesce(F.shiftright(doc_id, BITS), F.lit(NO_ID)).alias("c"),
        F.coalesce(doc_id.bitwiseAND((1 << BITS) - 1), F.lit(0)).cast("int").alias("p"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = stored(leaves.withColumn("shown", F.when(F.col("shown") != F.col("leaf"), F.col("shown"))), "merkle-leaves")
    nodes = ranked(leaves).withColumnRenamed("leaf", "digest")
    steps = tree(nodes, "merkle-blocks", "doc_id", "shown")
    subroots = steps[-1].select("key", F.lit(1).alias("one"), F.lit("").alias("all"), "digest")
    numbered = before(subroots, "all", "key", "one", "rank")
    sources = numbered.select(F.col("all").alias("key"), "rank", "digest", F.col("key").alias("source"))
    tops = tree(sources, "merkle-sources", "source")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    paths = tops[-1].select("key", F.col("block").alias("rank"), nothing.alias("path"), F.col("digest").alias("root"))
    for step in reversed(tops):
        last = unfold(step, paths)
        paths = last.select("key", "rank", "path", "root")
    found = last.select(F.col("item.source").alias("key"), F.lit(0).cast("long").alias("rank"), "path", F.col("item.digest").alias("subroot"), "root")
    paths = stored(found, "merkle-subroots")
    for step in reversed(steps):
        last = unfold(step, paths)
        paths = last.select("key", "rank", "path", "subroot", "root")
    leaf = F.col("item.digest")
    folded = fold(F.coalesce(F.col("item.shown"), leaf), F.col("path"))
    out = last.select(
        F.col("item.doc_id").alias("doc_id"), F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).alias("source"), "rank",
        leaf.alias("leaf"), "subroot", "root", "path", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_rows(id_col: str = "doc_id") -> Column:
    """Rows whose id's crc32 is even."""
    return F.crc32(F.col(id_col).cast("string")) % 2 == 0


def sql() -> str:
    """The same rows in DuckDB SQL: lists of a source's digests, level by level, sorted by id (ids not null and unique in a source)."""
    crc = (
        "list_reduce(range(8 * length(s)), lambda c, k: xor(CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])) ELSE c END >> 1, "
        "(CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])) ELSE c END & 1) * 3988292384), 4294967295)"
    )
    field = lambda x: f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    fields = " || ".join(field(f) for f in FIELDS)
    shown = " || ".join(field("replace(text, chr(10), '')" if f == "text" else f) for f in FIELDS)
    up = "list_transform(range((len(l) + 2) // 3), lambda i: sha256(array_to_string(l[3 * i + 1:3 * i + 3], '')))"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(':' || source, '-') AS key, sha256({fields}) AS leaf, sha256({shown}) AS other, CAST(doc_id AS VARCHAR) AS s FROM documents),
f AS MATERIALIZED (
  SELECT doc_id, key, leaf, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS r,
    CASE WHEN (xor(CAST({crc} AS UBIGINT), CAST(4294967295 AS UBIGINT)) & 1) = 0 THEN other ELSE leaf END AS shown FROM d),
levels(key, h, l) AS (
  SELECT key, 0, list(leaf ORDER BY doc_id) FROM f GROUP BY key
  UNION ALL SELECT key, h + 1, {up} FROM levels WHERE len(l) > 1),
subroots AS MATERIALIZED (SELECT key, h AS height, l[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS q FROM levels WHERE len(l) = 1),
tops(h, l) AS (
  SELECT 0, list(subroot ORDER BY key) FROM subroots
  UNION ALL SELECT h + 1, {up} FROM tops WHERE len(l) > 1),
root AS (SELECT l[1] AS root FROM tops WHERE len(l) = 1),
walk AS MATERIALIZED (
  SELECT f.doc_id, f.key, levels.h, f.r // CAST(pow(3, levels.h) AS BIGINT) AS pos, l FROM f JOIN levels ON f.key = levels.key WHERE len(l) > 1
  UNION ALL
  SELECT f.doc_id, f.key, 1000 + tops.h, q // CAST(pow(3, tops.h) AS BIGINT), l FROM f JOIN subroots ON f.key = subroots.key, tops WHERE len(l) > 1),
sides AS (
  SELECT doc_id, key, h, array_to_string(l[pos - pos % 3 + 1:pos], '') AS a, array_to_string(l[pos + 2:pos - pos % 3 + 3], '') AS b FROM walk),
path AS MATERIALIZED (SELECT doc_id, key, list(a ORDER BY h) AS a, list(b ORDER BY h) AS b FROM sides GROUP BY doc_id, key),
folded(doc_id, key, k, x) AS (
  SELECT doc_id, key, 0, shown FROM f
  UNION ALL SELECT g.doc_id, g.key, k + 1, sha256(a[k + 1] || x || b[k + 1]) FROM folded g JOIN path p ON p.doc_id = g.doc_id AND p.key = g.key WHERE k < len(a)),
ends AS (SELECT doc_id, key, max_by(x, k) AS folded_root FROM folded GROUP BY doc_id, key)
SELECT f.doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(range(len(a)), lambda i: a[i + 1] || b[i + 1]), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM f JOIN subroots ON subroots.key = f.key JOIN ends ON ends.doc_id = f.doc_id AND ends.key = f.key LEFT JOIN path ON path.doc_id = f.doc_id AND path.key = f.key, root"""
