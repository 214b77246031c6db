"""Storage-layer queries: triple table, vertical partitions, reductions, statistics.

They read the stored layouts: the triple table partitioned by predicate, the
profiles of its values, the reductions' statistics and the kept reductions, each written to the shared
folder by the first query of a session that needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.operators import extvp, sketches
from spogrid.operators.aggregates import summary
from spogrid.operators.patterns import bgp
from spogrid.plans.units import CHAIN, STAR
from spogrid.session import materialize

# a BGP used to exercise table choice: reviews, their product's label and a sparse rating
CHOICE_BGP = [
    ("?review", "shop:reviewFor", "?product"),
    ("?review", "shop:rating4", "?r4"),
    ("?product", "rdfs:label", "?label"),
    ("?product", "shop:productPropertyTextual4", "?t4"),
]
EMPTY_BGP = [("?x", "shop:price", "?p"), ("?x", "foaf:name", "?n")]


def tt_count(t) -> DataFrame:
    """Size of the stored triple table, by kind of object."""
    return t.stored.all.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def predicates(t) -> DataFrame:
    return extvp.predicates(t.store)


def vp_sizes(t) -> DataFrame:
    return extvp.vp_sizes(t.stored)


def related_predicates(t) -> DataFrame:
    return extvp.related_predicates(t.stored, "SS", t.value_profiles)


def _rel_sizes(t, rel: str) -> DataFrame:
    return extvp.reduction_counts(t.stored, [rel], t.value_profiles).select("p1", "p2", "size")


def extvp_ss(t) -> DataFrame:
    return _rel_sizes(t, "SS")


def extvp_os(t) -> DataFrame:
    return _rel_sizes(t, "OS")


def extvp_so(t) -> DataFrame:
    return _rel_sizes(t, "SO")


def extvp_stats(t) -> DataFrame:
    return t.reduction_stats.drop("bound", "stored")


def extvp_bounded(t) -> DataFrame:
    return t.reduction_stats.select("rel", "p1", "p2", "size", "stored")


def extvp_summary(t) -> DataFrame:
    return extvp.reduction_summary(t.reduction_stats, t.stored)


def extvp_storage(t) -> DataFrame:
    return extvp.storage(t.reduction_stats)


def extvp_rows(t) -> DataFrame:
    """Every kept reduction as it was written: rows, subjects, and smallest and largest object."""
    aggs = {"size": F.count(F.lit(1)), "min_obj": F.min("obj"), "max_obj": F.max("obj")}
    return summary(t.reductions, ["rel", "p1", "p2"], {"n_sub": "sub"}, aggs).select("rel", "p1", "p2", "size", "n_sub", "min_obj", "max_obj")


def choose_tables(t) -> DataFrame:
    return extvp.choose_tables(t.spark, CHOICE_BGP, t.reduction_stats)


def empty_relation(t) -> DataFrame:
    return extvp.empty_relations(t.spark, EMPTY_BGP, t.reduction_stats)


def bgp_extvp(t) -> DataFrame:
    """The table-choice BGP answered from the chosen reduced tables, as they were written.

    The choice is one row per pattern (planning metadata, bounded by the
    pattern count) and is collected to build the plan; the data never is.
    """
    choice = extvp.choose_tables(t.spark, CHOICE_BGP, t.reduction_stats).collect()
    tables = extvp.bgp_tables(t.stored, t.reductions, choice)
    return bgp(t.stored, CHOICE_BGP, tables=tables, sizes=extvp.bgp_sizes(CHOICE_BGP, choice)).select("review", "product", "r4", "label", "t4")


def _merged_sketches(t) -> DataFrame:
    """Sketches of two halves of the stored table, each written, then merged."""
    triples, half = t.stored.all, F.pmod(F.xxhash64("sub"), F.lit(2))
    parts = [materialize(sketches.sketch(triples.where(half == k)), "sketches") for k in (0, 1)]
    return materialize(sketches.merge(*parts), "sketches")


def sketch_stats(t) -> DataFrame:
    """Rows of each predicate from merged sketches, and whether the estimates lie within their bounds: 4 % of the
    exact distinct subjects and objects, and a rank of 45 to 55 % for the median."""
    est = sketches.estimates(_merged_sketches(t))
    # a row for each predicate; subjects and objects are told apart once each, with a mask of their predicates
    triples = t.stored.all.join(F.broadcast(est.select("pred", "median")), "pred")
    num = F.col("num").cast("double")
    aggs = {"c": F.count(num), "below": F.count(F.when(num < F.col("median"), 1)), "upto": F.count(F.when(num <= F.col("median"), 1))}
    exact = summary(triples, ["pred"], {"s": "sub", "o": "obj"}, aggs)
    near = lambda guess, true: F.abs(F.col(guess) - F.col(true)) <= F.col(true) * 0.04
    median = (F.col("c") == 0) | ((F.col("below") <= F.col("c") * 0.55) & (F.col("upto") >= F.col("c") * 0.45))
    return est.join(exact, "pred").select("pred", "n", near("n_sub", "s").alias("subjects_near"), near("n_obj", "o").alias("objects_near"), median.alias("median_near"))


def bgp_sketched(t) -> DataFrame:
    """The table-choice BGP, its joins in the order of the sketches' expected rows."""
    sizes = sketches.pattern_sizes(CHOICE_BGP, _merged_sketches(t))
    return bgp(t.stored, CHOICE_BGP, sizes=sizes).select("review", "product", "r4", "label", "t4")


def catalog_star(t) -> DataFrame:
    """Offers with their product, vendor and price, joined bucket by bucket from the catalog tables."""
    return bgp(t.bucketed, STAR, sizes=t.bucketed.sizes(STAR)).select("offer", "product", "vendor", "price")


def catalog_chain(t) -> DataFrame:
    """Regions of reviewed products' producers from the catalog tables, joins ordered by the layout's sizes."""
    return bgp(t.bucketed, CHAIN, sizes=t.bucketed.sizes(CHAIN)).select("review", "region")


def catalog_layout(t) -> DataFrame:
    """Rows, IRI objects, and first and last subject of each predicate, as its table's layout records them."""
    return t.bucketed.layout.select("pred", "n", "n_iri", "min_sub", "max_sub")
