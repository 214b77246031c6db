"""Mergeable statistics of predicates: HyperLogLog sketches of subjects and objects, KLL sketches of numbers.

One row a predicate, written beside the per-predicate tables. A batch of new triples is sketched by itself and
merged, without reading the old triples again; deletions cannot be taken back from a sketch, so estimates are of all
triples ever added until the sketches are written anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.sources.store import as_frame

# Registers of a HyperLogLog sketch (2 ** LG): a standard error of 0.8 % at 14.
LG = 14
# Size of a KLL sketch: a rank error of some 1.3 % at 200.
K = 200


def sketch(triples) -> DataFrame:
    """(pred, n, n_num, subs, objs, nums): counts and sketches of every predicate, aggregated before the shuffle."""
    nums = F.col("num").cast("double")
    return as_frame(triples).groupBy("pred").agg(
        F.count(F.lit(1)).alias("n"), F.count(nums).alias("n_num"), F.hll_sketch_agg("sub", F.lit(LG)).alias("subs"),
        F.hll_sketch_agg("obj", F.lit(LG)).alias("objs"), F.kll_sketch_agg_double(nums, F.lit(K)).alias("nums"),
    )


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The sketches of both inputs' triples; a predicate that one of them lacks is taken from the other."""
    b = new.select("pred", *[F.col(c).alias(f"__{c}") for c in new.columns if c != "pred"])
    both = old.join(b, "pred", "full")

    def side(c: str, merged: Column) -> Column:
        return F.when(F.col(c).isNull(), F.col(f"__{c}")).when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(merged).alias(c)

    return both.select(
        "pred", side("n", F.col("n") + F.col("__n")), side("n_num", F.col("n_num") + F.col("__n_num")),
        side("subs", F.hll_union("subs", "__subs")), side("objs", F.hll_union("objs", "__objs")),
        side("nums", F.kll_sketch_merge_double("nums", "__nums")),
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """(pred, n, n_sub, n_obj, median): exact rows, estimated distinct subjects and objects, estimated median (null without numbers)."""
    median = F.when(F.col("n_num") > 0, F.kll_sketch_get_quantile_double("nums", F.lit(0.5)))
    return sketches.select("pred", "n", F.hll_sketch_estimate("subs").alias("n_sub"), F.hll_sketch_estimate("objs").alias("n_obj"), median.alias("median"))


def pattern_sizes(patterns: Sequence[tuple[str, str, str]], sketches: DataFrame) -> list[float]:
    """Expected rows of each pattern, for the join order of ``bgp(sizes=...)``: a constant subject or object keeps its
    share of the predicate's rows. Collects a row for each predicate of the patterns."""
    names = sorted({p for _, p, _ in patterns if isinstance(p, str) and not p.startswith("?")})
    known = {r["pred"]: r for r in estimates(sketches.where(F.col("pred").isin(names))).collect()}
    total = None
    out = []
    for s, p, o in patterns:
        if isinstance(p, str) and p.startswith("?"):
            if total is None:
                total = float(sketches.agg(F.sum("n")).first()[0] or 0)
            out.append(total)
            continue
        r = known.get(p)
        size = float(r["n"]) if r else 0.0
        if r and not str(s).startswith("?"):
            size /= max(1, r["n_sub"])
        if r and not str(o).startswith("?"):
            size /= max(1, r["n_obj"])
        out.append(size)
    return out
