"""One query per single operator: patterns, filters, joins, aggregates, sets,
ordering, paths, hierarchies and query forms, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.functions import terms as T
from spogrid.functions.terms import Lit, num, ts
from spogrid.operators import aggregates as A
from spogrid.operators import algebra as G
from spogrid.operators import metrics
from spogrid.operators.aggregates import grouped_sets, ranked
from spogrid.operators.algebra import intersect, minus
from spogrid.operators.extvp import predicates
from spogrid.operators.paths import alt, between, closure, inv, levels, neg, opt, path, plus, seq, star
from spogrid.operators.patterns import assign, bgp, substitute, triple_pattern
from spogrid.operators.updates import construct, describe_where
from spogrid.sources.store import as_frame

P10 = "product/10"


def _vis(df: DataFrame) -> DataFrame:
    return G.visible(df)


# ---------------------------------------------------------------- patterns
def tp_predicate(tr):
    return _vis(triple_pattern(tr, ("?s", "rdfs:label", "?o")))


def tp_subject(tr):
    return _vis(triple_pattern(tr, (P10, "?p", "?o")))


def tp_object(tr):
    return _vis(triple_pattern(tr, ("?s", "shop:country", "nation/7")))


def tp_var_predicate(tr):
    return _vis(triple_pattern(tr, ("?s", "?p", "nation/7")))


def tp_review(tr):
    """All that is known of one review, and of what points to its reviewer: constants with composite keys."""
    review = bgp(tr, [("?r", "shop:reviewFor", P10)]).agg(F.min("r")).first()[0]
    about = _vis(triple_pattern(tr, (review, "?p", "?o"))).withColumn("s", F.lit(review))
    reviewer = bgp(tr, [(review, "rev:reviewer", "?x")]).first()["x"]
    return about.unionByName(_vis(triple_pattern(tr, ("?s", "?p", reviewer))).withColumn("o", F.lit(reviewer)))


def tp_blank(tr):
    return _vis(bgp(tr, [("_:r", "shop:reviewFor", "?product"), ("_:r", "rev:reviewer", "?reviewer")]))


def tp_repeat_var(tr):
    return _vis(triple_pattern(tr, ("?x", "?p", "?x")))


def project(tr):
    sol = bgp(tr, [("?offer", "shop:product", "?product"), ("?offer", "shop:vendor", "?vendor")])
    return G.project(sol, ["product", "vendor"])


# ---------------------------------------------------------------- filters
def filter_compare(tr):
    sol = bgp(
        tr,
        [("?offer", "shop:price", "?price"), ("?offer", "shop:validTo", "?date"), ("?offer", "shop:deliveryDays", "?dd")],
    )
    cond = (num("price") > 50000) & (ts("date") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (num("dd") != 3)
    return sol.where(cond).select("offer", "price")


def filter_logic(tr):
    sol = bgp(
        tr,
        [
            ("?p", "shop:productPropertyNumeric1", "?n1"),
            ("?p", "shop:productPropertyNumeric2", "?n2"),
            ("?p", "shop:productPropertyNumeric3", "?n3"),
        ],
    )
    return sol.where(((num("n1") > 40) | (num("n2") < 10)) & ~(num("n3") == 0)).select("p", "n1", "n2", "n3")


def filter_bound(tr):
    sol = bgp(
        tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")],
        optionals=[("?p", "shop:productPropertyTextual4", "?t4")],
    )
    return sol.where(F.col("t4").isNotNull()).select("p", "label", "t4")


def filter_regex(tr):
    sol = bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")])
    return sol.where(F.col("label").rlike("^(red|blue) [a-z]+$")).select("p", "label")


def filter_like(tr):
    sol = bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")])
    return sol.where(F.col("label").like("%gear%")).select("p", "label")


def filter_var_eq(tr):
    equal = {"?pub": "?v"}
    pats = substitute([("?offer", "shop:vendor", "?v"), ("?offer", "dc:publisher", "?pub")], equal)
    return _vis(assign(bgp(tr, pats), equal))


def param_query(tr, params=None):
    """A pattern template with placeholders filled from Python arguments."""
    params = params or {"ProductType": "type/PROMO", "ProductFeature1": "feature/cold", "x": 30}
    template = [
        ("?product", "rdfs:label", "?label"),
        ("?product", "rdf:type", "%ProductType%"),
        ("?product", "shop:productFeature", "%ProductFeature1%"),
        ("?product", "shop:productPropertyNumeric1", "?value1"),
    ]
    pats = [tuple(params.get(t.strip("%"), t) if isinstance(t, str) and t.startswith("%") else t for t in p) for p in template]
    return bgp(tr, pats).where(num("value1") > params["x"]).select("product", "label")


# ---------------------------------------------------------------- joins
STAR = [
    ("?offer", "shop:product", "?product"),
    ("?offer", "shop:vendor", "?vendor"),
    ("?offer", "shop:price", "?price"),
    ("?offer", "shop:deliveryDays", "?dd"),
    ("?offer", "shop:validTo", "?date"),
]
CHAIN = [
    ("?review", "shop:reviewFor", "?product"),
    ("?product", "shop:producer", "?producer"),
    ("?producer", "shop:country", "?country"),
    ("?country", "shop:locatedIn", "?region"),
]
SNOWFLAKE = [
    ("?offer", "shop:product", "?product"),
    ("?offer", "shop:vendor", "?vendor"),
    ("?product", "shop:producer", "?producer"),
    ("?producer", "shop:country", "?pcountry"),
    ("?vendor", "shop:country", "?vcountry"),
    ("?product", "rdf:type", "?type"),
    ("?type", "rdf:type", "shop:ProductType"),
]


def bgp_star(tr):
    return bgp(tr, STAR).select("offer", "product", "vendor", "price")


def bgp_chain(tr):
    return bgp(tr, CHAIN).select("review", "region")


def bgp_snowflake(tr):
    return bgp(tr, SNOWFLAKE).select("offer", "pcountry", "vcountry", "type")


def group_join(tr):
    a = bgp(tr, [("?o", "shop:product", "?p"), ("?o", "shop:vendor", "?v")])
    b = bgp(tr, [("?o", "dc:publisher", "?v"), ("?o", "shop:price", "?price")])
    return _vis(G.join(a, b))


def join_unbound(tr):
    a = G.optional(bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")]),
                   bgp(tr, [("?p", "shop:productPropertyTextual4", "?t")]))
    b = bgp(tr, [("?p", "shop:productPropertyTextual4", "?t"), ("?p", "shop:productPropertyNumeric1", "?n")])
    return G.join(a, b, maybe_unbound=["t"]).select("p", "label", "t", "n")


def sequence_join(tr):
    return _vis(
        G.sequence_join(
            bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")]),
            bgp(tr, [("?p", "shop:productFeature", "?f")]),
            bgp(tr, [("?f", "rdfs:label", "?flabel")]),
        )
    ).select("p", "label", "f", "flabel")


def optional(tr):
    sol = bgp(tr, [("?p", "rdf:type", "shop:Product")], optionals=[("?p", "shop:productPropertyNumeric4", "?n4")])
    return _vis(sol)


def optional_filter(tr):
    main = bgp(tr, [("?p", "rdf:type", "shop:Product")])
    opt = bgp(tr, [("?p", "shop:productPropertyNumeric4", "?n4")])
    return G.optional(main, opt, cond=num("n4") > 200).select("p", "n4")


def optional_nested(tr):
    main = bgp(tr, [("?r", "rdf:type", "rev:Review")])
    inner = G.optional(bgp(tr, [("?r", "shop:rating2", "?r2")]), bgp(tr, [("?r", "shop:rating3", "?r3")]))
    return G.optional(main, inner).select("r", "r2", "r3")


def optional_disjoint(tr):
    """OPTIONAL whose group shares no variable: a left join on the filter condition."""
    regions = bgp(tr, [("?r", "rdf:type", "shop:Region"), ("?r", "rdfs:label", "?rl")])
    countries = bgp(tr, [("?c", "rdf:type", "shop:Country"), ("?c", "rdfs:label", "?cl")])
    cond = F.substring(F.col("cl"), 1, 1) == F.substring(F.col("rl"), 1, 1)
    return G.optional(regions, countries, cond=cond).select("r", "rl", "c", "cl")


def semi_join(tr):
    return G.exists(
        bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")]),
        bgp(tr, [("?r", "shop:reviewFor", "?p")]),
    ).select("p", "label")


def anti_join(tr):
    """Products without any review that has a fourth rating (FILTER NOT EXISTS)."""
    return G.not_exists(
        bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")]),
        bgp(tr, [("?r", "shop:reviewFor", "?p"), ("?r", "shop:rating4", "?x")]),
    ).select("p", "label")


def anti_optional(tr):
    sol = bgp(
        tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")],
        optionals=[("?p", "shop:productPropertyTextual4", "?t4")],
    )
    return sol.where(F.col("t4").isNull()).select("p", "label")


def band_join(tr):
    """Products sharing a feature with product 10 and within two numeric bands."""
    orig = bgp(
        tr,
        [
            (P10, "shop:productFeature", "?f"),
            (P10, "shop:productPropertyNumeric1", "?o1"),
            (P10, "shop:productPropertyNumeric2", "?o2"),
        ],
    ).select("f", num("o1").alias("o1"), num("o2").alias("o2"))
    other = bgp(
        tr,
        [
            ("?p", "shop:productFeature", "?f"),
            ("?p", "shop:productPropertyNumeric1", "?s1"),
            ("?p", "shop:productPropertyNumeric2", "?s2"),
        ],
    ).select("p", "f", num("s1").alias("s1"), num("s2").alias("s2"))
    out = G.band_join(other, orig, keys=["f"], bands={("s1", "o1"): 10, ("s2", "o2"): 50})
    return out.where(F.col("p") != P10).select("p").distinct()


def theta_join(tr):
    sol = bgp(tr, [(P10, "shop:producer", "?pr"), ("?p", "shop:producer", "?pr")])
    return sol.where(F.col("p") != P10).select("p", "pr")


def self_join(tr):
    pats = substitute(
        [(P10, "shop:productFeature", "?f"), ("?other", "shop:productFeature", "?f2")], {"?f2": "?f"}
    )
    return _vis(bgp(tr, pats)).select("other", "f")


def right_join(tr):
    reviews = bgp(tr, [("?review", "shop:reviewFor", "?p")])
    products = bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")])
    return reviews.join(products.select("p", "label"), "p", "right").select("p", "label", "review")


def scalar_subquery(tr):
    offers = bgp(tr, [("?offer", "shop:price", "?price")]).withColumn("cents", A.cents(F.col("price")))
    # the global total is a scalar subquery: computed once, no join at all
    g = offers.agg(F.struct(F.sum("cents").alias("s"), F.count(F.lit(1)).alias("c"))).scalar()
    sol = offers.where(F.col("cents") * g.getField("c") > g.getField("s"))
    return sol.select("offer", "price")


def interval_lookup(tables):
    """Customer key -> nation whose cumulative upper bound is the first >= key."""
    from spogrid.operators.algebra import interval_lookup as lookup

    c = tables.customer
    bounds = c.groupBy(F.col("c_nationkey").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    ids = c.select(F.col("c_custkey").alias("id"))
    return lookup(ids, bounds, order="owner", size="n")


def ordered_diff(tables):
    """Positions at which two ordered answers differ: product labels, and the same with rows changed and left out."""
    p = tables.entities.product.select("nr", "label")
    changed = p.where(F.col("nr") % 70 != 0).withColumn("label", F.when(F.col("nr") % 50 == 0, F.upper("label")).otherwise(F.col("label")))
    diff = metrics.ordered_diff(p.orderBy("label", "nr"), changed.orderBy("label", "nr"))
    cells = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("expected", "actual") for c in ("nr", "label")]
    return diff.select("pos", *cells)


# ---------------------------------------------------------------- aggregates
def _reviews(tr):
    return bgp(tr, [("?review", "shop:reviewFor", "?product")])


def agg_count(tr):
    return _reviews(tr).groupBy("product").agg(F.count("review").alias("n"))


def agg_avg(tr):
    sol = bgp(tr, [("?review", "shop:reviewFor", "?product"), ("?review", "shop:rating1", "?r")])
    return sol.groupBy("product").agg(A.exact_avg(F.sum(num("r")), F.count(num("r"))).alias("avgRating"))


def agg_minmax(tr):
    sol = bgp(tr, [("?offer", "shop:vendor", "?vendor"), ("?offer", "shop:price", "?price")])
    return sol.groupBy("vendor").agg(F.min(num("price")).alias("minPrice"), F.max(num("price")).alias("maxPrice"))


def agg_having(tr):
    sol = bgp(tr, [("?offer", "shop:product", "?product")])
    return sol.groupBy("product").agg(F.count("offer").alias("n")).where(F.col("n") >= 35)


def agg_nested(tr):
    sol = bgp(tr, [("?review", "shop:reviewFor", "?product"), ("?review", "rev:reviewer", "?r"), ("?r", "shop:country", "?country")])
    per = sol.groupBy("country", "product").agg(F.count("review").alias("n"))
    return per.groupBy("country").agg(F.max("n").alias("maxReviews"))


def agg_ratio(tr):
    reviews = _reviews(tr).groupBy("product").agg(F.count("review").alias("nReviews"))
    offers = bgp(tr, [("?offer", "shop:product", "?product")]).groupBy("product").agg(F.count("offer").alias("nOffers"))
    return A.ratio(reviews, offers, ["product"], "nReviews", "nOffers", "reviewsPerOffer")


def argmax_group(tr):
    sol = bgp(tr, [("?offer", "shop:vendor", "?vendor"), ("?vendor", "shop:country", "?country")])
    per = sol.groupBy("country", "vendor").agg(F.count("offer").alias("n"))
    return A.argmax(per, ["country"], "n")


def agg_union(tr):
    ratings = tuple(f"shop:rating{i}" for i in (1, 2, 3, 4))
    sol = bgp(tr, [("?review", "shop:reviewFor", "?product"), ("?review", ratings, "?score")])
    return sol.groupBy("product").agg(A.exact_avg(F.sum(num("score")), F.count(num("score"))).alias("avgScore"))


def below_group_avg(tr):
    offers = bgp(tr, [("?offer", "shop:product", "?product"), ("?offer", "shop:price", "?price")])
    flagged = A.below_group_avg(offers.withColumn("cents", A.cents(F.col("price"))), ["product"], "cents")
    return flagged.groupBy("product").agg(
        F.count(F.when(F.col("below"), 1)).alias("belowAvg"), F.count(F.lit(1)).alias("offerCount")
    )


def distinct(tr):
    return bgp(tr, [("?offer", "shop:product", "?product"), ("?offer", "shop:vendor", "?vendor")]).select(
        "product", "vendor"
    ).distinct()


def word_count(tr):
    return A.word_count(triple_pattern(tr, ("?s", "rdfs:label", "?label")), "label")


# ---------------------------------------------------------------- sets and order
def union_pad(tr):
    return _vis(
        G.union(
            bgp(tr, [("?p", "shop:productPropertyTextual4", "?t4")]),
            bgp(tr, [("?p", "shop:productPropertyTextual5", "?t5")]),
        )
    )


def union_distinct(tr):
    a = bgp(tr, [("?v", "shop:country", "?c"), ("?v", "rdf:type", "shop:Vendor")])
    b = bgp(tr, [("?x", "shop:country", "?c"), ("?x", "rdf:type", "shop:Producer")])
    return G.slice_(G.union(a, b), project=["c"], distinct=True, order=["c"], limit=10)


def result_diff(tr):
    """Multiset difference of two answers: labels of type-PROMO products versus
    labels of products with feature 'cold'."""
    from spogrid.operators.metrics import result_diff as diff

    a = bgp(tr, [("?p", "rdf:type", "type/PROMO"), ("?p", "rdfs:label", "?label")]).select("label")
    b = bgp(tr, [("?p", "shop:productFeature", "feature/cold"), ("?p", "rdfs:label", "?label")]).select("label")
    return diff(a, b)


def _labels(tr):
    return bgp(tr, [("?p", "rdfs:label", "?label"), ("?p", "rdf:type", "shop:Product")]).select("p", "label")


def order_by(tr):
    return G.slice_(_labels(tr), order=[F.asc("label"), F.desc("p")])


def order_expr(tr):
    sol = bgp(tr, [("?offer", "shop:price", "?price")])
    return G.slice_(sol, order=[F.col("price").cast("double").desc(), "offer"], limit=10, project=["offer", "price"])


def limit(tr):
    return G.slice_(_labels(tr), order=["label", "p"], limit=10)


def offset_limit(tr):
    return G.slice_(_labels(tr), order=["label", "p"], offset=20, limit=10)


def topk_sub(tr):
    counts = bgp(tr, [("?offer", "shop:vendor", "?vendor")]).groupBy("vendor").agg(F.count("offer").alias("n"))
    top = G.slice_(counts, order=[F.desc("n"), "vendor"], limit=5)
    return G.join(top, bgp(tr, [("?vendor", "rdfs:label", "?name")])).select("vendor", "n", "name")


# ---------------------------------------------------------------- paths and hierarchies
def path_seq(tr):
    return _vis(path(tr, "?review", seq("rev:reviewer", "shop:country"), "?country"))


def path_alt(tr):
    return _vis(path(tr, "?x", alt("rdfs:label", "foaf:name"), "?name"))


def path_inv(tr):
    return _vis(path(tr, "?product", inv("shop:product"), "?offer"))


def path_mix(tr):
    """Who reviewed each product: an inverse step inside a sequence."""
    return _vis(path(tr, "?product", seq(inv("shop:reviewFor"), "rev:reviewer"), "?person"))


# Products are joined by people who reviewed both.
CO_REVIEWED = seq(inv("shop:reviewFor"), "rev:reviewer", inv("rev:reviewer"), "shop:reviewFor")


def path_star(tr):
    """Everything in a country from which partners lead to nation 1, in no step or more."""
    return _vis(path(tr, "?x", seq("shop:country", star("shop:partner")), "nation/1"))


def path_plus(tr):
    """Products that shared reviewers connect with product 10."""
    return _vis(path(tr, "product/10", plus(CO_REVIEWED), "?product"))


def path_opt(tr):
    """Reviews of a producer or of its products."""
    return _vis(path(tr, "?review", seq("shop:reviewFor", opt("shop:producer")), "producer/12"))


def path_all_pairs(tr):
    """Both ends unbound: nations that partners lead to, in one step or more."""
    return _vis(path(tr, "?a", plus("shop:partner"), "?b"))


def path_negated(tr):
    """What product 10 is linked with, but by its type and features, or as reviewed."""
    return _vis(path(tr, "product/10", neg("rdf:type", "shop:productFeature", inverse=("shop:reviewFor",)), "?x"))


def path_between(tr):
    """How many shared reviewers lie between two products, at least."""
    return between(tr, "product/10", plus(CO_REVIEWED), "product/20")


def _labelled(tr):
    """Products with a textual property that not all have, and with a numeric one."""
    return [bgp(tr, [("?p", "rdf:type", "shop:Product")], optionals=[("?p", k, "?v")]) for k in ("shop:productPropertyTextual4", "shop:productPropertyTextual5")]


def _both(tr):
    a, b = (_vis(x).withColumn("v", F.col("v").isNotNull()) for x in _labelled(tr))
    key = F.expr("CAST(substring(p, 9) AS BIGINT) % 6").alias("k")
    return [x.select(F.when(key > 0, key).alias("k"), "v") for x in (a, b)]


def intersect_set(tr):
    return intersect(*_both(tr))


def intersect_bag(tr):
    return intersect(*_both(tr), bag=True)


def except_set(tr):
    return minus(*_both(tr))


def except_bag(tr):
    return minus(*_both(tr), bag=True)


def _reviewed(tr):
    """Reviews with product type, the language of the text (unbound without one) and the reviewer."""
    return bgp(tr, [("?r", "shop:reviewFor", "?p"), ("?p", "rdf:type", "?t"), ("?r", "rev:reviewer", "?c")], optionals=[("?r", "shop:rating3", "?g")]).where(F.col("t") != "shop:Product")


def _subtotals(df):
    aggs = {"n": F.count(F.lit(1)), "people": F.countDistinct("c")}
    return df, aggs


def agg_rollup(tr):
    df, aggs = _subtotals(_reviewed(tr))
    return grouped_sets(df, [("t", "g"), ("t",), ()], aggs)


def agg_cube(tr):
    df, aggs = _subtotals(_reviewed(tr))
    return grouped_sets(df, [("t", "g"), ("t",), ("g",), ()], aggs)


def agg_grouping_sets(tr):
    df, aggs = _subtotals(_reviewed(tr))
    return grouped_sets(df, [("t",), ("g",)], aggs)


def global_rank(tr):
    """Rank and dense rank of all offers by days of delivery, then by price."""
    offers = bgp(tr, [("?o", "shop:price", "?price"), ("?o", "shop:deliveryDays", "?days")])
    offers = offers.select("o", num("days").cast("long").alias("days"), F.col("price").cast("decimal(18,2)").alias("price"))
    return ranked(ranked(offers, ["days"], "by_days"), ["days", "price"], "by_price").select("o", "by_days", "by_days_dense", "by_price", "by_price_dense")


def _subclass_edges(tr):
    return triple_pattern(tr, ("?child", "rdfs:subClassOf", "?parent")).select("child", "parent")


def type_closure(tr):
    """Every product typed with its class and all ancestors (forward chaining)."""
    direct = bgp(tr, [("?product", "rdf:type", "?type"), ("?type", "rdf:type", "shop:ProductType")])
    anc = closure(_subclass_edges(tr))
    inferred = direct.join(anc.select(F.col("child").alias("type"), "ancestor"), "type").select(
        "product", F.col("ancestor").alias("type")
    )
    return direct.select("product", "type").unionByName(inferred).distinct()


def type_levels(tr):
    """Depth of every node of the class and place hierarchies (root = 0)."""
    edges = _subclass_edges(tr).unionByName(
        triple_pattern(tr, ("?child", "shop:locatedIn", "?parent")).select("child", "parent")
    )
    return levels(edges)


def type_features(tr):
    """Features of each class, including those of products of its subclasses."""
    direct = bgp(
        tr, [("?product", "rdf:type", "?type"), ("?type", "rdf:type", "shop:ProductType"), ("?product", "shop:productFeature", "?feature")]
    ).select("type", "feature").distinct()  # few rows for each class go up the hierarchy, not its products
    anc = closure(_subclass_edges(tr)).select(F.col("child").alias("type"), "ancestor")
    above = direct.join(anc, "type").select(F.col("ancestor").alias("type"), "feature")
    return direct.unionByName(above).distinct()


# ---------------------------------------------------------------- query forms
def describe_q(tr):
    return describe_where(tr, [("?x", "rdf:type", "type/PROMO")], "?x")


def construct_q(tr):
    sol = bgp(tr, [("?offer", "shop:vendor", "?v"), ("?v", "shop:country", "?c")])
    return construct(sol, [("?offer", "export:vendorCountry", "?c"), ("?c", "export:hasOffer", "?offer")])


# ---------------------------------------------------------------- terms
def lang_matches(tr):
    sol = triple_pattern(tr, ("?r", "rev:text", "?text"))
    return sol.groupBy(T.lang("text").alias("lang")).agg(
        F.count(F.when(T.lang_matches(T.lang("text"), "EN"), 1)).alias("en"),
        F.count(F.when(T.lang_matches(T.lang("text"), "*"), 1)).alias("any"),
    )


def fn_str(tr):
    sol = bgp(tr, [("?p", "shop:producer", "?pr"), ("?pr", "rdfs:label", "?l")])
    return sol.select("p", F.concat(T.term("pr"), F.lit(" "), F.col("l")).alias("s"))


def fn_cast(tr):
    sol = bgp(tr, [("?offer", "shop:price", "?price"), ("?offer", "shop:deliveryDays", "?dd")])
    return sol.select(
        "offer",
        T.cast_term(F.col("price"), "xsd:decimal").alias("priceDec"),
        T.cast_term(F.col("dd"), "xsd:integer").alias("ddInt"),
        T.cast_term(F.col("offer"), "xsd:integer").alias("bad"),
    )


def iri_prefix(tr):
    p = predicates(tr).select(F.col("pred").alias("p"))
    full = T.expand(F.col("p"))
    return p.select("p", full.alias("full"), T.shorten(full).alias("short"))


def iri_clean(tr):
    p = predicates(tr).select(F.col("pred").alias("p"))
    return p.select("p", T.clean_iri(T.expand(F.col("p"))).alias("clean"))


def fn_arith(tr):
    sol = bgp(tr, [("?offer", "shop:deliveryDays", "?dd"), ("?offer", "shop:price", "?price")])
    c = A.cents(F.col("price"))
    return sol.select(
        "offer",
        (num("dd") * 2 + 1).alias("a"),
        (num("dd") - 7).alias("b"),
        (c.cast("double") / num("dd")).alias("c"),
    )
