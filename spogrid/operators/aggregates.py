"""Aggregation operators beyond a plain ``groupBy().agg()``.

All are skew-safe compositions: group-level values are computed with a
partial (map-side) aggregation and joined back on the group key, never with a
window partitioned by a possibly hot key.  AQE turns the join into a broadcast
when the aggregate is small at run time and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spogrid.session import materialize


def cents(lexical_price: Column) -> Column:
    """Exact integer cents of a decimal lexical price; sums stay exact in any order."""
    return (lexical_price.cast("decimal(18,2)") * 100).cast("bigint")


def exact_avg(total: Column, count: Column) -> Column:
    """Average from an exact sum and count, divided once in double."""
    return total.cast("double") / count


# Groups that a mask of 64 bits tells apart.
_MASK = 60


def summary(df: DataFrame, keys: Sequence[str], distinct: dict[str, str], aggs: dict[str, Column]) -> DataFrame:
    """``aggs`` of each group, and exact numbers of distinct values (``{name: column}``, null is none), for groups that are few:
    their list passes through the driver.  Keys are not null.

    Texts among the aggregates are not shuffled with the values that are told apart: those go once each, with
    a mask of the groups that they are in, one value's rows of a task together."""
    # beside a collected set, Spark holds smallest and largest texts in a hash map; alone they would sort all rows by group
    alone = df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()], F.collect_set(F.lit(1)).alias("__any"))
    out = materialize(alone.where(F.size("__any") > 0).drop("__any"), "groups")
    groups = out.select(*keys).collect()
    if not groups:
        return out.withColumns({k: F.lit(0).cast("long") for k in distinct})
    index = df.sparkSession.createDataFrame([(*g, k) for k, g in enumerate(groups)], out.select(*keys, F.lit(0).alias("__k")).schema)
    # an outer join, though every row has its group: an inner one would test keys for null, which makes computed ones twice
    numbered = df.join(F.broadcast(index), list(keys), "left")
    n_masks = (len(groups) - 1) // _MASK + 1
    for name, value in distinct.items():
        bit = F.expr(f"shiftleft(1L, __k % {_MASK})")
        masks = [F.bit_or(F.when(F.floor(F.col("__k") / _MASK) == m, bit)).alias(f"__m{m}") for m in range(n_masks)]
        values = numbered.where(F.col(value).isNotNull()).groupBy(value).agg(*masks)
        held = F.array(*[F.coalesce(f"__m{m}", F.lit(0).cast("long")) for m in range(n_masks)])
        inside = F.expr(f"filter(sequence(0, {len(groups) - 1}), k -> shiftright(__held[k div {_MASK}], k % {_MASK}) & 1 = 1)")
        counted = values.select(held.alias("__held")).select(F.explode(inside).alias("__k")).groupBy("__k").agg(F.count(F.lit(1)).alias(name))
        counted = index.join(counted, "__k", "left").select(*keys, F.coalesce(name, F.lit(0).cast("long")).alias(name))
        out = out.join(counted, list(keys))
    return out


def argmax(df: DataFrame, group: Sequence[str], by: str, alias: str = "max") -> DataFrame:
    """Rows whose ``by`` equals the maximum of their group (all ties kept)."""
    m = df.groupBy(*group).agg(F.max(by).alias(f"__{alias}"))
    return df.join(m, list(group)).where(F.col(by) == F.col(f"__{alias}")).drop(f"__{alias}")


def ratio(a: DataFrame, b: DataFrame, on: Sequence[str], num: str, den: str, alias: str = "ratio") -> DataFrame:
    """Join two aggregates on their key and divide one by the other (double)."""
    return a.join(b, list(on)).withColumn(alias, F.col(num).cast("double") / F.col(den))


def below_group_avg(
    df: DataFrame, group: Sequence[str], value: str, flag: str = "below"
) -> DataFrame:
    """Flag rows whose (integer) value is below the average of their group.

    Compares ``value * count < sum`` so the test is exact.
    """
    g = df.groupBy(*group).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"))
    out = df.join(g, list(group))
    return out.withColumn(flag, F.col(value) * F.col("__c") < F.col("__s")).drop("__s", "__c")


def window_index(ts: Column, start: str, days: int) -> Column:
    """Index of the ``days``-long tumbling window from ``start`` that holds ``ts``."""
    return F.floor(F.datediff(F.to_date(ts), F.lit(start).cast("date")) / F.lit(days)).cast("bigint")


def word_count(df: DataFrame, text: str, word: str = "word", count: str = "n") -> DataFrame:
    """Frequency of each lower-cased word (split on anything but letters and digits)."""
    words = df.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias(word))
    return words.where(F.col(word) != "").groupBy(word).agg(F.count(F.lit(1)).alias(count))


def grouped_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over several groupings at once, in one pass over the solutions.

    Each row has all grouped variables and ``grouping``: a bit for every variable that its
    grouping leaves out, the first variable's highest, so that an unbound variable (null, bit 0) is told from a
    subtotal (null, bit 1). Distinct aggregates are allowed.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.grouping_id().cast("long").alias("grouping"), *[c.alias(k) for k, c in aggs.items()])
    return out.select(*names, "grouping", *aggs)


def ranked(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with the rank (``name``) and dense rank (``name``_dense) of each row over all rows, ascending, ties equal.

    The distinct values are counted (pre-aggregated, so a value that many rows have is one), numbered by
    ranges with the rows before them, and joined back: no task holds all rows.
    """
    values = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).repartitionByRange(*by)
    values = materialize(values.withColumn("__part", F.spark_partition_id()), "ranks")
    sums = values.groupBy("__part").agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("values"))
    parts = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = sums.select("__part", *(F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(c) for c in ("rows", "values")))
    inner = Window.partitionBy("__part").orderBy(*by)
    before = F.coalesce(F.sum("__n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumns({"__before": before, "__row": F.row_number().over(inner)}).join(sums, "__part")
    values = values.select(*[F.col(c).alias(f"__{c}") for c in by], (F.col("rows") + F.col("__before") + 1).alias(name), (F.col("values") + F.col("__row")).alias(f"{name}_dense"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return df.join(values, same).drop(*[f"__{c}" for c in by])


def neighbours(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``value`` of the row before (lag_value, after its name) and after (lead_value) in its key's order.

    Rows are dealt by ranges of (key, order), so a hot key spreads over many tasks; the last and first row of a key in each
    range cross the borders. ``order`` should tell a key's rows apart; a null key is a key like others.
    """
    dealt = materialize(df.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()), "neighbours")
    held = F.struct(F.col(value).alias("v"))
    # null keys and orders come first in a range, and a struct compares them so
    at = F.struct(*order)
    ends = dealt.groupBy(key, "__part").agg(F.min_by(held, at).alias("__first"), F.max_by(held, at).alias("__last"))
    ranges = Window.partitionBy(key).orderBy("__part")  # a row for each range of the key
    ends = ends.withColumns({"__before": F.lag("__last").over(ranges), "__after": F.lead("__first").over(ranges)})
    ends = ends.where("__before IS NOT NULL OR __after IS NOT NULL").select(F.col(key).alias("__key"), F.col("__part").alias("__p"), "__before", "__after")
    inner = Window.partitionBy("__part", key).orderBy(*order)
    rows = dealt.withColumns({"__lag": F.lag(held).over(inner), "__lead": F.lead(held).over(inner)})
    out = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")), "left")
    return out.select(
        *df.columns, F.coalesce("__lag", "__before").getField("v").alias(f"lag_{value}"), F.coalesce("__lead", "__after").getField("v").alias(f"lead_{value}")
    )
