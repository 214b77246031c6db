"""SPARQL algebra over solution DataFrames: join, optional, union, exists, slice.

Solutions are DataFrames with one column per variable (NULL = unbound).
Joins are on *all* shared variables.  Variables that may be unbound on a side
(after OPTIONAL or UNION) need SPARQL compatibility rather than SQL equality;
only those are named in ``maybe_unbound`` since such a condition cannot be a
hash key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spogrid.operators.patterns import _RIGHT, natural_join, renamed, same_term, shared_vars, variables
from spogrid.session import materialize


def _drop_dup_aux(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.drop(*[c for c in b.columns if "__" in c and c in a.columns])


def _compatible_join(
    a: DataFrame, b: DataFrame, how: str, maybe_unbound: Sequence[str] = (), cond: Column | None = None
) -> DataFrame:
    shared = shared_vars(a, b)
    b = renamed(a, b)
    parts = []
    for v in shared:
        eq = same_term(a, b, v)
        if v in maybe_unbound:
            eq = eq | F.col(v).isNull() | F.col(v + _RIGHT).isNull()
        parts.append(eq)
    on = reduce(lambda x, y: x & y, parts) if parts else F.lit(True)
    if cond is not None:
        # shared names resolve to the left side, equal to the right under the join
        on = on & cond
    out = a.join(b, on, how)
    for v in (v for v in shared if v in maybe_unbound):
        # the side that binds the variable describes it
        described = [c for c in b.columns if c.endswith(_RIGHT) and c.split("__")[0] == v and c != v + _RIGHT]
        out = out.withColumns(
            {c[: -len(_RIGHT)]: F.when(F.col(v).isNull(), F.col(c)).otherwise(F.col(c[: -len(_RIGHT)])) for c in described}
        )
        out = out.withColumn(v, F.coalesce(F.col(v), F.col(v + _RIGHT)))
    return out.drop(*[c for c in b.columns if c.endswith(_RIGHT)])


def join(a: DataFrame, b: DataFrame, maybe_unbound: Sequence[str] = ()) -> DataFrame:
    """Inner join of two groups on all shared variables."""
    if not maybe_unbound:
        return natural_join(a, b)
    return _compatible_join(a, b, "inner", maybe_unbound)


def sequence_join(*dfs: DataFrame) -> DataFrame:
    """Join of n groups, in the given order."""
    return reduce(join, dfs)


def optional(a: DataFrame, b: DataFrame, cond: Column | None = None, maybe_unbound: Sequence[str] = ()) -> DataFrame:
    """OPTIONAL: left outer join on shared variables; a FILTER inside the
    OPTIONAL is part of the join condition (``cond``).  With no shared variable
    it is still a left join (unmatched left rows kept)."""
    if cond is None and not maybe_unbound:
        if shared_vars(a, b):
            return natural_join(a, b, "left")
    return _compatible_join(a, b, "left", maybe_unbound, cond)


def union(*dfs: DataFrame) -> DataFrame:
    """UNION (bag): variables missing on one side become unbound."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def exists(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """FILTER EXISTS / IN: left semi join."""
    return _half_join(a, b, on, "left_semi")


def not_exists(a: DataFrame, b: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """FILTER NOT EXISTS / NOT IN / OPTIONAL + !bound: left anti join."""
    return _half_join(a, b, on, "left_anti")


def _half_join(a: DataFrame, b: DataFrame, on: Sequence[str] | None, how: str) -> DataFrame:
    on = list(on) if on is not None else shared_vars(a, b)
    b = renamed(a, b.select(*[c for c in b.columns if c.split("__")[0] in on]))
    return a.join(b, reduce(lambda x, y: x & y, [same_term(a, b, v) for v in on]), how)


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cross product (patterns without a shared variable)."""
    return a.crossJoin(_drop_dup_aux(a, b))


def band_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str], bands: dict[tuple[str, str], float], strict: bool = True
) -> DataFrame:
    """Equi-join on ``keys`` with ``|a.x - b.y| < bound`` for each ``(x, y): bound``.

    The equality keys make it a hash / sort-merge join; the bands are a
    residual condition, never a cross product.
    """
    b2 = b
    for k in keys:
        b2 = b2.withColumnRenamed(k, k + "__r")
    cond = reduce(lambda x, y: x & y, [F.col(k) == F.col(k + "__r") for k in keys])
    for (x, y), bound in bands.items():
        d = F.abs(F.col(x) - F.col(y))
        cond = cond & ((d < bound) if strict else (d <= bound))
    return a.join(b2, cond, "inner").drop(*[k + "__r" for k in keys])


def slice_(
    df: DataFrame,
    order: Sequence[Column | str] = (),
    offset: int = 0,
    limit: int | None = None,
    distinct: bool = False,
    project: Sequence[str] | None = None,
) -> DataFrame:
    """Solution modifiers in SPARQL order: order -> project -> distinct -> offset -> limit.

    Without DISTINCT the sort may use variables that are not projected; with
    DISTINCT it orders the projected rows.  ORDER BY + LIMIT plans as a top-k
    (TakeOrderedAndProject), not a full sort.  ``limit=0`` gives an empty result.
    """
    if distinct:
        if project is not None:
            df = df.select(*project)
        df = df.distinct()
        if order:
            df = df.orderBy(*order)
    else:
        if order:
            df = df.orderBy(*order)
        if project is not None:
            df = df.select(*project)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def visible(df: DataFrame) -> DataFrame:
    """Drop auxiliary term columns."""
    return df.select(*variables(df))


def interval_lookup(ids: DataFrame, bounds: DataFrame, order: str, size: str, id_col: str = "id") -> DataFrame:
    """Owner of each id: the first owner (in ``order``) whose cumulative upper bound
    (running sum of ``size``) is >= id; ids past the last bound get NULL.

    Both the running sum and the lookup go by range partitions, so neither needs all
    rows in one task or a join on a range alone.  Owners are
    dealt by ``order`` and summed within a partition, upon the totals of those before it.  Then ids and
    bounds are dealt together by value and sorted: the owner of an id is that of the next
    bound, in its partition or else the first bound of a later one.  What crosses
    partitions is one row for each of them.  A null id has no owner.
    """
    w_order = Window.partitionBy("part").orderBy("owner")
    dealt = bounds.select(F.col(order).alias("owner"), F.col(size).alias("n")).repartitionByRange("owner")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "owners")
    sums = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    running = dealt.withColumn("hi", F.sum("n").over(w_order.rowsBetween(Window.unboundedPreceding, 0))).join(sums, "part")
    his = running.select((F.col("base") + F.col("hi")).alias("v"), F.lit(True).alias("bound"), "owner", F.lit(None).alias("id"))

    # an id goes before a bound of its own value; of bounds with one value the first owner's counts
    both = ids.select(F.col(id_col).alias("v"), F.lit(False).alias("bound"), F.lit(None).alias("owner"), F.col(id_col).alias("id"))
    both = both.where("v IS NOT NULL").unionByName(his).repartitionByRange("v")
    both = materialize(both.withColumn("part", F.spark_partition_id()), "intervals")
    firsts = both.where("bound").groupBy("part").agg(F.min(F.struct("v", "owner")).alias("f"))
    parts = both.select("part").distinct().join(firsts, "part", "left")
    later = F.first("f", ignorenulls=True).over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    parts = parts.select("part", later.alias("later"))
    # backwards, the next bound is the last one seen: a frame that only grows, where one to the end would be read again for each row
    w = Window.partitionBy("part").orderBy(*[F.desc(c) for c in ("v", "bound", "owner")]).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("bound"), F.struct("owner")), ignorenulls=True).over(w)
    found = both.withColumn("here", here).where("NOT bound").join(parts, "part")
    out = found.select(F.col("id").alias(id_col), F.coalesce("here.owner", "later.owner").alias("owner"))
    missing = ids.where(F.col(id_col).isNull()).select(id_col, F.lit(None).cast(out.schema["owner"].dataType).alias("owner"))
    return out.unionByName(missing)


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each solution of either side once, with its number in ``a`` and in ``b``. All columns count, those that
    tell terms apart too; unbound equals unbound. One aggregation of both sides, pre-aggregated before the shuffle."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"different variables: {a.columns} and {b.columns}")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = a.withColumns({"__n": one, "__m": none}).unionByName(b.withColumns({"__n": none, "__m": one}))
    return both.groupBy(*a.columns).agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m"))


def _times(counted: DataFrame, n: Column) -> DataFrame:
    out = counted.withColumn("__k", n).where("__k > 0")
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__k"))).drop("__n", "__m", "__k")


def intersect(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    """Solutions of both sides: each once, or as a bag as often as in the side that has fewer of it."""
    c = _counted(a, b)
    return _times(c, F.least("__n", "__m")) if bag else c.where("__n > 0 AND __m > 0").drop("__n", "__m")


def minus(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    """Solutions of ``a`` that ``b`` lacks: each once, or as a bag as often as ``a`` has more of it."""
    c = _counted(a, b)
    return _times(c, F.col("__n") - F.col("__m")) if bag else c.where("__n > 0 AND __m = 0").drop("__n", "__m")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_key: str, right_at: str, right_cols: Sequence[str], tie: str) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of the same key at or before its time: ``right_cols``,
    null without such a row; of rows of one time the one with the largest ``tie``.

    Both sides are dealt together into ranges of (key, time), so a key with many rows lies in many partitions.
    Within a partition the rows are merged in order; one row a key, the last before the
    partition, is carried across borders. Rows of ``left`` with a null key or time match nothing.
    """
    cols = left.columns
    order = F.struct(F.col(right_at).alias("at"), F.col(tie).alias("tie"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(right_cols)])
    r = right.where(F.col(right_key).isNotNull() & F.col(right_at).isNotNull())
    r = r.select(F.col(right_key).alias("__key"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), order.alias("__right"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("__left"))
    rows = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__right"].dataType).alias("__right"), F.struct(*cols).alias("__left"))
    both = r.unionByName(rows.where("__key IS NOT NULL AND __at IS NOT NULL")).repartitionByRange("__key", "__at", "__side")
    both = materialize(both.withColumn("__part", F.spark_partition_id()), "as-of")
    # the last row of each key in a partition; only keys that lie in several partitions carry one
    lasts = both.groupBy("__key", "__part").agg(F.max("__right").alias("last"))
    wide = lasts.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    carried = F.max("last").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    borders = lasts.join(wide, "__key", "left_semi").select("__key", "__part", carried.alias("__carried"))
    inner = Window.partitionBy("__part", "__key").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("__here", F.max("__right").over(inner)).where("__side = 1").join(borders, ["__key", "__part"], "left")
    got = F.coalesce("__here", "__carried")
    out = merged.select("__left.*", *[got[f"c{i}"].alias(c if c not in cols else f"right_{c}") for i, c in enumerate(right_cols)])
    return out.unionByName(left.where(F.col(key).isNull() | F.col(at).isNull()), allowMissingColumns=True)
