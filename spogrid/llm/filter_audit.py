"""Filter interaction audit: what each document filter removes alone, after others, and in every order.

Plan. (1) One pass reads every text and returns the set of filters it fails, as
bits of a mask; identical texts meet by their SHA-256 digests, pre-aggregated,
and only digests held by several rows are joined back. (2) Masks are counted for
each part: at most 32 rows a part, whatever its size. (3) From these counts the
removals v(S) of all 32 coalitions S of filters are tabulated: a document is
removed by S if it fails a filter of S. (4) Shapley values: the kernel-weighted
least squares fit of v by an additive game, constrained to be exact on the empty
and on the full coalition, is solved in rationals. Its solution is linear in v, so
the normal equations are solved once, for unit right-hand sides; times 120 the
coefficients are whole numbers, and the products with v stay exact longs. (5) A
step of an order removes v(S + f) - v(S), where S holds the filters before f, so
all 600 steps of a part are differences of its tabulated removals.

Defined cases: a null text counts as empty; a null doc_id is neither a smaller one nor has one; rows
with one doc_id are not each other's smaller; a null source and an empty one
are one part; a doc_id with several label rows has a label if any of them says so;
null labels say nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.llm.shared import stored

FILTERS = "ABCDE"
N = len(FILTERS)
ALL = (1 << N) - 1
ORDERS = factorial(N)

# What separates words: space, and tab to carriage return.
BLANKS = " \t\n\v\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 2, "[#$%&*|]"


def solve(rows: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The exact solution of a square system for several right-hand sides (Gauss-Jordan)."""
    m = [[*a, *b] for a, b in zip(rows, right, strict=True)]
    for k in range(len(m)):
        pivot = next(r for r in range(k, len(m)) if m[r][k])
        m[k], m[pivot] = m[pivot], m[k]
        m[k] = [x / m[k][k] for x in m[k]]
        for r in range(len(m)):
            if r != k and m[r][k]:
                m[r] = [x - m[r][k] * y for x, y in zip(m[r], m[k], strict=True)]
    return [row[len(rows) :] for row in m]


@cache
def shapley_weights() -> tuple[tuple[int, ...], ...]:
    """For each filter 32 whole numbers: their sum over v(S) is 120 times its Shapley value.

    Least squares over the coalitions that are neither empty nor full, each with the kernel
    weight (n - 1) / (C(n, s) s (n - s)), under the constraint that the values
    add up to v(all) - v(none); a multiplier adds one row to the normal equations.
    """
    inner = [s for s in range(1, ALL)]
    weight = {s: Fraction(N - 1, comb(N, k) * k * (N - k)) for s in inner for k in [s.bit_count()]}
    bit = lambda s, i: s >> i & 1
    normal = [[sum((weight[s] * bit(s, i) * bit(s, j) for s in inner), Fraction(0)) for j in range(N)] + [Fraction(1)] for i in range(N)]
    normal.append([Fraction(1)] * N + [Fraction(0)])
    # right-hand sides for v = 1 on one coalition; v(none) is taken off every other
    right = [[weight[s] * bit(s, i) if s in weight else Fraction(0) for s in range(ALL + 1)] for i in range(N)]
    for row in right:
        row[0] = -sum(row[1:], Fraction(0))
    right.append([Fraction(-1)] + [Fraction(0)] * (ALL - 1) + [Fraction(1)])
    found = [[x * ORDERS for x in row] for row in solve(normal, right)[:N]]
    if any(x.denominator != 1 for row in found for x in row):
        raise ArithmeticError("120 times a Shapley value is a whole number")
    return tuple(tuple(int(x) for x in row) for row in found)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = (n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text), text.rlike(SIGNS))
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row: the filters that it fails, as bits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"),
    )
    rows = stored(rows, "filter-masks")
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return rows.join(repeated, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << (N - 1)).otherwise(0)).alias("mask"))


def tabulate(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, total, removed, good, toxic) with 32 numbers in each array: rows that a coalition of
    filters removes, those of quality 1 among them, and the toxic ones."""
    says = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    says = says.groupBy("doc_id").agg(F.max("q").alias("q"), F.max("t").alias("t")).where("doc_id IS NOT NULL")
    counted = rows.join(says, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.count_if("t").alias("t"))
    sums = [
        F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)) for s in range(ALL + 1))).alias(name)
        for c, name in (("n", "removed"), ("q", "good"), ("t", "toxic"))
    ]
    return counted.groupBy("part").agg(F.sum("n").alias("total"), *sums)


def steps_of(table: DataFrame) -> DataFrame:
    """Each row 600 times, with ``filter_order`` (120), ``step`` (5), the step's filter ``f`` and the
    coalitions ``before`` and ``after`` it."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    out = table.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(N))))
    number = lambda k: F.instr(F.lit(FILTERS), F.substring("filter_order", k, 1)) - 1
    bits = [F.when(F.col("step") >= k, F.pow(F.lit(2), number(F.lit(k))).cast("int")).otherwise(0) for k in range(1, N + 1)]
    out = out.withColumn("f", number(F.col("step"))).withColumn("after", sum(bits, F.lit(0)))
    return out.withColumn("before", F.col("after") - F.expr("shiftleft(1, f)"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each part, order and step; the columns of the query ``op13_filter_audit``."""
    table = tabulate(masks(docs, id_col, text_col, source_col), labels, id_col)
    values = [sum((F.lit(w) * F.col("removed")[s] for s, w in enumerate(ws) if w), F.lit(0)) for ws in shapley_weights()]
    table = table.withColumn("shapley", F.array(*values))
    s = steps_of(table)
    gain = lambda c: F.col(c)[F.col("after")] - F.col(c)[F.col("before")]
    alone = F.expr("removed[shiftleft(1, f)]")
    return s.select(
        "part", "filter_order", "step",
        (F.col("total") - F.col("removed")[F.col("after")]).alias("kept"),
        gain("removed").alias("removed"),
        (alone - gain("removed")).alias("redundant"),
        (F.col("removed")[ALL] - F.expr(f"removed[{ALL} - shiftleft(1, f)]")).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        F.col("shapley")[F.col("f")].alias("shapley"),
    )


def sql() -> str:
    """The same rows in DuckDB SQL, counted step by step over the failures of single documents."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS m FROM d GROUP BY text),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
    CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(d.text) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(d.text, '{SIGNS}') THEN 'D' ELSE '' END,
    CASE WHEN d.doc_id > m THEN 'E' ELSE '' END) AS fails
  FROM d JOIN least ON least.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM steps),
hits AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
    contains(fails, f) AS fail, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
  FROM c, s),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost
  FROM hits GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted"""
