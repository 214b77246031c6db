"""The business-intelligence workload: aggregates over graph patterns.

Averages of prices are computed from exact integer cent sums; each ratio is
one double division, so the numbers do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.functions.terms import num, ts
from spogrid.operators.aggregates import argmax, below_group_avg, cents, exact_avg, window_index
from spogrid.operators.algebra import join, not_exists, slice_
from spogrid.operators.patterns import bgp, substitute


RATINGS = tuple(f"shop:rating{i}" for i in (1, 2, 3, 4))


def bi1(tr, country1="nation/3", country2="nation/7") -> DataFrame:
    """Product types most reviewed by reviewers of one country for producers of another."""
    sol = bgp(
        tr,
        [
            ("?productType", "rdf:type", "shop:ProductType"),
            ("?product", "rdf:type", "?productType"),
            ("?product", "shop:producer", "?producer"),
            ("?producer", "shop:country", country1),
            ("?review", "shop:reviewFor", "?product"),
            ("?review", "rev:reviewer", "?reviewer"),
            ("?reviewer", "shop:country", country2),
        ],
    )
    agg = sol.groupBy("productType").agg(F.count("review").alias("reviewCount"))
    return slice_(agg, order=[F.desc("reviewCount"), "productType"], limit=10)


def bi2(tr, product="product/10") -> DataFrame:
    """Products sharing the most features with a product (feature equality as a join)."""
    pats = substitute(
        [(product, "shop:productFeature", "?feature"), ("?otherProduct", "shop:productFeature", "?otherFeature")],
        {"?otherFeature": "?feature"},
    )
    shared = bgp(tr, pats).groupBy("otherProduct").agg(F.count("feature").alias("sameFeatures"))
    typed = bgp(tr, [("?otherProduct", "rdf:type", "shop:Product")])
    sol = join(typed, shared).where(F.col("otherProduct") != product)
    return slice_(sol, project=["otherProduct", "sameFeatures"], order=[F.desc("sameFeatures"), "otherProduct"], limit=10)


def bi3(tr, start="1997-01-01", days=28) -> DataFrame:
    """Products whose review count grew most from one 28-day window to the next.

    Both windows come from one pass: each review gets its window index, and one
    aggregation counts windows 0 and 1 per product (no self-join of subselects).
    """
    sol = bgp(tr, [("?review", "shop:reviewFor", "?product"), ("?review", "dc:date", "?date")])
    w = window_index(ts("date"), start, days)
    counts = (
        sol.withColumn("w", w)
        .where(F.col("w").isin(0, 1))
        .groupBy("product")
        .agg(
            F.count(F.when(F.col("w") == 1, F.col("review"))).alias("monthCount"),
            F.count(F.when(F.col("w") == 0, F.col("review"))).alias("monthBeforeCount"),
        )
        .where((F.col("monthCount") > 0) & (F.col("monthBeforeCount") > 0))
    )
    out = counts.select("product", (F.col("monthCount").cast("double") / F.col("monthBeforeCount")).alias("ratio"))
    return slice_(out, order=[F.desc("ratio"), "product"], limit=10)


def _type_offers(tr, ptype: str, vendor: bool = False) -> DataFrame:
    pats = [("?product", "rdf:type", ptype), ("?offer", "shop:product", "?product"), ("?offer", "shop:price", "?price")]
    if vendor:
        pats.append(("?offer", "shop:vendor", "?vendor"))
    return bgp(tr, pats).withColumn("cents", cents(F.col("price")))


def bi4(tr, ptype="type/PROMO") -> DataFrame:
    """Price effect of each feature: average offer price with the feature over without it.

    Without-feature totals are the type's totals minus the with-feature totals,
    so there is no product x feature cross product with a NOT EXISTS.
    """
    offers = _type_offers(tr, ptype)
    total = offers.agg(F.struct(F.sum("cents").alias("ts"), F.count(F.lit(1)).alias("tc"))).scalar()
    feats = bgp(tr, [("?product", "shop:productFeature", "?feature")])
    with_f = (
        join(offers, feats).groupBy("feature").agg(F.sum("cents").alias("sw"), F.count(F.lit(1)).alias("cw"))
    )
    sol = with_f.select("*", total.getField("ts").alias("ts"), total.getField("tc").alias("tc"))
    sol = sol.where(F.col("tc") - F.col("cw") > 0)
    ratio = exact_avg(F.col("sw"), F.col("cw")) / exact_avg(F.col("ts") - F.col("sw"), F.col("tc") - F.col("cw"))
    return slice_(sol.select("feature", ratio.alias("priceRatio")), order=[F.desc("priceRatio"), "feature"], limit=10)


def bi5(tr, ptype="type/PROMO") -> DataFrame:
    """Per reviewer country, the most reviewed products of a type (ties kept), with
    their average price.  The price branch never binds ``?country``, so it joins
    every country: a join where ``country`` may be unbound."""
    reviews = bgp(
        tr,
        [
            ("?product", "rdf:type", ptype),
            ("?review", "shop:reviewFor", "?product"),
            ("?review", "rev:reviewer", "?reviewer"),
            ("?reviewer", "shop:country", "?country"),
        ],
    )
    counts = reviews.groupBy("country", "product").agg(F.count("review").alias("nrOfReviews"))
    best = argmax(counts, ["country"], "nrOfReviews")
    prices = (
        _type_offers(tr, ptype)
        .groupBy("product")
        .agg((exact_avg(F.sum("cents"), F.count(F.lit(1))) / 100).alias("avgPrice"))
        .withColumn("country", F.lit(None).cast("string"))
    )
    sol = join(best, prices, maybe_unbound=["country"])
    return sol.select("country", "product", "nrOfReviews", "avgPrice").orderBy(
        F.desc("nrOfReviews"), "country", "product"
    )


def _scores(tr, producer: str, with_reviewer: bool) -> DataFrame:
    pats = [("?product", "shop:producer", producer), ("?review", "shop:reviewFor", "?product")]
    if with_reviewer:
        pats.append(("?review", "rev:reviewer", "?reviewer"))
    return bgp(tr, [*pats, ("?review", RATINGS, "?score")])


def bi6(tr, producer="producer/3") -> DataFrame:
    """Reviewers whose average rating of a producer's products is 1.5 x the producer average."""
    overall = _scores(tr, producer, False).agg(exact_avg(F.sum(num("score")), F.count(num("score")))).scalar()
    per = (
        _scores(tr, producer, True)
        .groupBy("reviewer")
        .agg(exact_avg(F.sum(num("score")), F.count(num("score"))).alias("reviewerAvgScore"))
    )
    sol = per.where(F.col("reviewerAvgScore") > overall * 1.5)
    return sol.select("reviewer", "reviewerAvgScore")


def bi7(tr, ptype="type/PROMO", country="nation/15", top=1000) -> DataFrame:
    """Of the top-1000 most offered products of a type, those with no vendor in a country."""
    counts = (
        bgp(tr, [("?product", "rdf:type", ptype), ("?offer", "shop:product", "?product")])
        .groupBy("product")
        .agg(F.count("offer").alias("offerCount"))
    )
    best = slice_(counts, order=[F.desc("offerCount"), "product"], limit=top)
    local = bgp(
        tr,
        [("?offer", "shop:product", "?product"), ("?offer", "shop:vendor", "?vendor"), ("?vendor", "shop:country", country)],
    )
    return not_exists(best, local, on=["product"]).select("product")


def bi8(tr, ptype="type/PROMO") -> DataFrame:
    """Vendors with the largest share of offers priced below their product's average."""
    offers = _type_offers(tr, ptype, vendor=True)
    flagged = below_group_avg(offers, ["product"], "cents")
    per = flagged.groupBy("vendor").agg(
        F.count(F.when(F.col("below"), F.col("offer"))).alias("belowAvg"), F.count("offer").alias("offerCount")
    )
    out = per.where(F.col("belowAvg") > 0).select(
        "vendor", (F.col("belowAvg").cast("double") / F.col("offerCount")).alias("cheapExpensiveRatio")
    )
    return slice_(out, order=[F.desc("cheapExpensiveRatio"), "vendor"], limit=10)
