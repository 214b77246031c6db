"""The explore workload: twelve product-search questions as graph patterns.

Each function takes the triple DataFrame and its parameters and returns a
solution DataFrame; column names are the projected variable names.
Parameters default to values with non-empty answers on the test data.
Every ORDER BY ends with a unique column so LIMIT is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.functions.terms import lang, lang_matches, num, ts
from spogrid.operators.algebra import optional, slice_, union
from spogrid.operators.patterns import bgp
from spogrid.operators.updates import construct, describe_where

PRODUCT = "product/10"


def explore1(tr: DataFrame, ptype="type/PROMO", f1="feature/cold", f2="feature/gear", x=5) -> DataFrame:
    """Products of a type with two features and a numeric bound; top 10 by label."""
    sol = bgp(
        tr,
        [
            ("?product", "rdfs:label", "?label"),
            ("?product", "rdf:type", ptype),
            ("?product", "shop:productFeature", f1),
            ("?product", "shop:productFeature", f2),
            ("?product", "shop:productPropertyNumeric1", "?value1"),
        ],
    ).where(num("value1") > x)
    return slice_(sol, project=["product", "label"], distinct=True, order=["label", "product"], limit=10)


def explore2(tr: DataFrame, product=PRODUCT) -> DataFrame:
    """One product's details with three optional properties."""
    P = product
    main = bgp(
        tr,
        [
            (P, "rdfs:label", "?label"),
            (P, "rdfs:comment", "?comment"),
            (P, "shop:producer", "?p"),
            ("?p", "rdfs:label", "?producer"),
            (P, "dc:publisher", "?p"),
            (P, "shop:productFeature", "?f"),
            ("?f", "rdfs:label", "?productFeature"),
            (P, "shop:productPropertyTextual1", "?propertyTextual1"),
            (P, "shop:productPropertyTextual2", "?propertyTextual2"),
            (P, "shop:productPropertyTextual3", "?propertyTextual3"),
            (P, "shop:productPropertyNumeric1", "?propertyNumeric1"),
            (P, "shop:productPropertyNumeric2", "?propertyNumeric2"),
        ],
        optionals=[
            (P, "shop:productPropertyTextual4", "?propertyTextual4"),
            (P, "shop:productPropertyTextual5", "?propertyTextual5"),
            (P, "shop:productPropertyNumeric4", "?propertyNumeric4"),
        ],
    )
    return main.select(
        "label", "comment", "producer", "productFeature", "propertyTextual1", "propertyTextual2",
        "propertyTextual3", "propertyNumeric1", "propertyNumeric2", "propertyTextual4",
        "propertyTextual5", "propertyNumeric4",
    )


def explore3(
    tr: DataFrame, ptype="type/PROMO", f1="feature/cold", f2="feature/gear", x=5, y=450
) -> DataFrame:
    """Products with one feature but without another (OPTIONAL + !bound)."""
    sol = bgp(
        tr,
        [
            ("?product", "rdfs:label", "?label"),
            ("?product", "rdf:type", ptype),
            ("?product", "shop:productFeature", f1),
            ("?product", "shop:productPropertyNumeric1", "?p1"),
            ("?product", "shop:productPropertyNumeric3", "?p3"),
        ],
    ).where((num("p1") > x) & (num("p3") < y))
    opt = bgp(tr, [("?product", "shop:productFeature", f2), ("?product", "rdfs:label", "?testVar")])
    sol = optional(sol, opt).where(F.col("testVar").isNull())
    return slice_(sol, project=["product", "label"], order=["label", "product"], limit=10)


def explore4(
    tr: DataFrame, ptype="type/PROMO", f1="feature/cold", f2="feature/gear", f3="feature/widget", x=5, y=3
) -> DataFrame:
    """Either of two feature sets (UNION), DISTINCT, OFFSET 5 LIMIT 10."""

    def branch(f, pred, var, bound):
        return bgp(
            tr,
            [
                ("?product", "rdfs:label", "?label"),
                ("?product", "rdf:type", ptype),
                ("?product", "shop:productFeature", f1),
                ("?product", "shop:productFeature", f),
                ("?product", "shop:productPropertyTextual1", "?propertyTextual"),
                ("?product", pred, var),
            ],
        ).where(num(var) > bound)

    sol = union(
        branch(f2, "shop:productPropertyNumeric1", "?p1", x), branch(f3, "shop:productPropertyNumeric2", "?p2", y)
    )
    return slice_(
        sol,
        project=["product", "label", "propertyTextual"],
        distinct=True,
        order=["label", "product", "propertyTextual"],
        offset=5,
        limit=10,
    )


def explore5(tr: DataFrame, product=PRODUCT, band1=10, band2=50) -> DataFrame:
    """Similar products: a shared feature and two numeric bands (band join)."""
    P = product
    sol = bgp(
        tr,
        [
            (P, "shop:productFeature", "?prodFeature"),
            ("?product", "shop:productFeature", "?prodFeature"),
            (P, "shop:productPropertyNumeric1", "?origProperty1"),
            ("?product", "shop:productPropertyNumeric1", "?simProperty1"),
            (P, "shop:productPropertyNumeric2", "?origProperty2"),
            ("?product", "shop:productPropertyNumeric2", "?simProperty2"),
            ("?product", "rdfs:label", "?productLabel"),
        ],
    )
    d1 = num("simProperty1") - num("origProperty1")
    d2 = num("simProperty2") - num("origProperty2")
    sol = sol.where(
        (F.col("product") != P) & (d1 < band1) & (d1 > -band1) & (d2 < band2) & (d2 > -band2)
    )
    return slice_(
        sol, project=["product", "productLabel"], distinct=True, order=["productLabel", "product"], limit=5
    )


def explore6(tr: DataFrame, word="widget") -> DataFrame:
    """Products whose label matches a regular expression."""
    sol = bgp(tr, [("?product", "rdfs:label", "?label"), ("?product", "rdf:type", "shop:Product")])
    return sol.where(F.col("label").rlike(word)).select("product", "label")


def explore7(tr: DataFrame, product=PRODUCT, country="nation/21", date="1998-01-01") -> DataFrame:
    """A product with its recent offers from one country and its reviews (nested OPTIONALs)."""
    P = product
    main = bgp(tr, [(P, "rdfs:label", "?productLabel")], keep_consts=True)
    offers = bgp(
        tr,
        [
            ("?offer", "shop:product", P),
            ("?offer", "shop:price", "?price"),
            ("?offer", "shop:vendor", "?vendor"),
            ("?vendor", "rdfs:label", "?vendorTitle"),
            ("?vendor", "shop:country", country),
            ("?offer", "dc:publisher", "?vendor"),
            ("?offer", "shop:validTo", "?date"),
        ],
        keep_consts=True,
    ).where(ts("date") > F.lit(date).cast("timestamp_ntz"))
    reviews = bgp(
        tr,
        [
            ("?review", "shop:reviewFor", P),
            ("?review", "rev:reviewer", "?reviewer"),
            ("?reviewer", "foaf:name", "?revName"),
            ("?review", "dc:title", "?revTitle"),
        ],
        keep_consts=True,
        optionals=[("?review", f"shop:rating{i}", f"?rating{i}") for i in (1, 2)],
    )
    sol = optional(optional(main, offers), reviews)
    return sol.select(
        "productLabel", "offer", "price", "vendor", "vendorTitle", "review", "revTitle", "reviewer", "revName",
        "rating1", "rating2",
    )


def explore8(tr: DataFrame, product=PRODUCT, language="EN") -> DataFrame:
    """Recent reviews of a product in one language, with optional ratings."""
    sol = bgp(
        tr,
        [
            ("?review", "shop:reviewFor", product),
            ("?review", "dc:title", "?title"),
            ("?review", "rev:text", "?text"),
            ("?review", "shop:reviewDate", "?reviewDate"),
            ("?review", "rev:reviewer", "?reviewer"),
            ("?reviewer", "foaf:name", "?reviewerName"),
        ],
        optionals=[("?review", f"shop:rating{i}", f"?rating{i}") for i in (1, 2, 3, 4)],
    ).where(lang_matches(lang("text"), language))
    sol = slice_(sol, order=[ts("reviewDate").desc(), "review"], limit=20)
    return sol.select(
        "title", "text", "reviewDate", "reviewer", "reviewerName", "rating1", "rating2", "rating3", "rating4"
    )


def first_of(tr: DataFrame, var: str, pred: str, product: str = PRODUCT) -> DataFrame:
    """One-row parameter table: the smallest ``?var`` with ``?var pred product``."""
    return bgp(tr, [(f"?{var}", pred, product)]).agg(F.min(var).alias(var))


def explore9(tr: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """DESCRIBE the reviewer of a review: all triples about that person."""
    review = review if review is not None else first_of(tr, "review", "shop:reviewFor")
    return describe_where(tr, [("?review", "rev:reviewer", "?x")], "?x", seed=review)


def explore10(tr: DataFrame, product=PRODUCT, country="nation/17", max_days=3, date="1998-01-01") -> DataFrame:
    """Cheap, fast offers of a product from vendors of one country, cheapest 10."""
    sol = bgp(
        tr,
        [
            ("?offer", "shop:product", product),
            ("?offer", "shop:vendor", "?vendor"),
            ("?offer", "dc:publisher", "?vendor"),
            ("?vendor", "shop:country", country),
            ("?offer", "shop:deliveryDays", "?deliveryDays"),
            ("?offer", "shop:price", "?price"),
            ("?offer", "shop:validTo", "?date"),
        ],
    ).where((num("deliveryDays") <= max_days) & (ts("date") > F.lit(date).cast("timestamp_ntz")))
    sol = slice_(sol, project=["offer", "price"], distinct=True)
    return slice_(sol, order=[F.col("price").cast("double"), "offer"], limit=10)


def explore11(tr: DataFrame, offer: DataFrame | None = None) -> DataFrame:
    """Everything about an offer, in both directions (variable predicate, UNION)."""
    o = offer if offer is not None else first_of(tr, "offer", "shop:product")
    # the defining pattern is implied by the seed; it tells the store that ?offer
    # is an offer IRI, so only offer-shaped branches are scanned
    known = ("?offer", "shop:product", "?__product")
    out_ = bgp(tr, [known, ("?offer", "?property", "?hasValue")], seed=o)
    in_ = bgp(tr, [known, ("?isValueOf", "?property", "?offer")], seed=o)
    return union(out_.select("property", "hasValue"), in_.select("property", "isValueOf"))


EXPORT_TEMPLATE = [
    ("?offer", "export:product", "?productURI"),
    ("?offer", "export:productlabel", "?productlabel"),
    ("?offer", "export:vendor", "?vendorname"),
    ("?offer", "export:vendorhomepage", "?vendorhomepage"),
    ("?offer", "export:offerURL", "?offerURL"),
    ("?offer", "export:price", "?price"),
    ("?offer", "export:deliveryDays", "?deliveryDays"),
    ("?offer", "export:validuntil", "?validTo"),
]


def explore12(tr: DataFrame, offer: DataFrame | None = None) -> DataFrame:
    """CONSTRUCT an export record of an offer."""
    o = offer if offer is not None else first_of(tr, "offer", "shop:product")
    sol = bgp(
        tr,
        [
            ("?offer", "shop:product", "?productURI"),
            ("?productURI", "rdfs:label", "?productlabel"),
            ("?offer", "shop:vendor", "?vendorURI"),
            ("?vendorURI", "rdfs:label", "?vendorname"),
            ("?vendorURI", "foaf:homepage", "?vendorhomepage"),
            ("?offer", "shop:offerWebpage", "?offerURL"),
            ("?offer", "shop:price", "?price"),
            ("?offer", "shop:deliveryDays", "?deliveryDays"),
            ("?offer", "shop:validTo", "?validTo"),
        ],
        seed=o,
    )
    return construct(sol, EXPORT_TEMPLATE)
