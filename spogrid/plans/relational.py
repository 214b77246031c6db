"""The explore questions asked of the relational entity tables (no triples).

IN / NOT IN are semi / anti joins; the unconditional outer joins of the
product-page query become joins on the product key both sides share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.operators.algebra import slice_

P = 10


def _of_type(e, ptype="PROMO") -> DataFrame:
    ptp = e.producttypeproduct.where(F.col("productType") == ptype).select(F.col("product").alias("nr"))
    return e.product.join(ptp, "nr", "left_semi")


def _with_feature(e, f) -> DataFrame:
    return e.productfeatureproduct.where(F.col("productFeature") == f).select(F.col("product").alias("nr"))


def rel1(t, f1="cold", f2="gear", x=5):
    e = t.entities
    p = _of_type(e).where(F.col("propertyNum1") > x)
    p = p.join(_with_feature(e, f1), "nr", "left_semi").join(_with_feature(e, f2), "nr", "left_semi")
    return slice_(p, project=["nr", "label"], distinct=True, order=["label", "nr"], limit=10)


def rel2(t, nr=P):
    e = t.entities
    pt = e.product.where(F.col("nr") == nr)
    pr = e.producer.select(F.col("nr").alias("producer"))
    pfp = e.productfeatureproduct.select(F.col("product").alias("nr"), "productFeature")
    out = pt.join(pfp, "nr").join(pr, "producer", "left_semi")
    return out.select(
        "label", "comment", "producer", "productFeature", "propertyTex1",
        "propertyTex2", "propertyTex3", "propertyNum1", "propertyNum2", "propertyTex4", "propertyTex5", "propertyNum4",
    )


def rel3(t, f1="cold", f2="gear", x=5, y=450):
    e = t.entities
    p = _of_type(e).where((F.col("propertyNum1") > x) & (F.col("propertyNum3") < y))
    p = p.join(_with_feature(e, f1), "nr", "left_semi").join(_with_feature(e, f2), "nr", "left_anti")
    return slice_(p, project=["nr", "label"], order=["label", "nr"], limit=10)


def rel4(t, f1="cold", f2="gear", f3="widget", x=5, y=3):
    e = t.entities
    p = _of_type(e).join(_with_feature(e, f1), "nr", "left_semi")
    a = p.where(F.col("propertyNum1") > x).join(_with_feature(e, f2), "nr", "left_semi")
    b = p.where(F.col("propertyNum2") > y).join(_with_feature(e, f3), "nr", "left_semi")
    u = a.unionByName(b)
    return slice_(u, project=["nr", "label", "propertyTex1"], distinct=True, order=["label", "nr"], offset=5, limit=10)


def rel5(t, nr=P, b1=10, b2=50):
    e = t.entities
    feats = e.productfeatureproduct.where(F.col("product") == nr).select("productFeature")
    similar = e.productfeatureproduct.join(feats, "productFeature").select(F.col("product").alias("nr")).distinct()
    po = e.product.where(F.col("nr") == nr).agg(
        F.struct(F.max("propertyNum1").alias("o1"), F.max("propertyNum2").alias("o2"))
    ).scalar()  # the values of product nr, as a scalar subquery
    p = e.product.join(similar, "nr").select("*", po.getField("o1").alias("o1"), po.getField("o2").alias("o2"))
    p = p.where(
        (F.col("nr") != nr)
        & (F.col("propertyNum1") < F.col("o1") + b1) & (F.col("propertyNum1") > F.col("o1") - b1)
        & (F.col("propertyNum2") < F.col("o2") + b2) & (F.col("propertyNum2") > F.col("o2") - b2)
    )
    return slice_(p, project=["nr", "label"], distinct=True, order=["label", "nr"], limit=5)


def rel6(t, word="widget"):
    return t.entities.product.where(F.col("label").like(f"%{word}%")).select("nr", "label")


def rel7(t, nr=P, country=21, date="1998-01-01"):
    e = t.entities
    p = e.product.where(F.col("nr") == nr).select(F.col("nr").alias("k"), "label")
    v = e.vendor.where(F.col("country") == country).select(F.col("nr").alias("vnr"), F.col("label").alias("vlabel"))
    ov = (
        e.offer.where((F.col("product") == nr) & (F.col("validTo") > F.lit(date).cast("timestamp_ntz")))
        .join(v, F.col("vendor") == F.col("vnr"))
        .select(F.col("product").alias("k"), F.col("nr").alias("onr"), "price", "vnr", "vlabel")
    )
    rpn = (
        e.review_core.where(F.col("product") == nr)
        .join(e.review_order.select("nr", "person"), "nr")
        .join(e.person.select(F.col("nr").alias("pnnr"), "name"), F.col("person") == F.col("pnnr"))
        .select(F.col("product").alias("k"), F.col("nr").alias("rnr"), "title", "pnnr", "name", "rating1", "rating2")
    )
    both = ov.join(rpn, "k", "right")
    out = p.join(both, "k", "left")
    return out.select("label", "onr", "price", "vnr", "vlabel", "rnr", "title", "pnnr", "name", "rating1", "rating2")


def rel8(t, nr=P, language="en"):
    e = t.entities
    r = e.review.where((F.col("product") == nr) & (F.col("language") == language))
    r = r.join(e.person.select(F.col("nr").alias("person"), "name"), "person")
    r = slice_(r, order=[F.desc("reviewDate"), "nr"], limit=20)
    return r.select("title", "text", "reviewDate", "person", "name", "rating1", "rating2", "rating3", "rating4")


def _first_review(e, nr=P) -> DataFrame:
    return e.review_core.where(F.col("product") == nr).agg(F.min("nr").alias("rnr"))


def _first_offer(e, nr=P) -> DataFrame:
    return e.offer.where(F.col("product") == nr).agg(F.min("nr").alias("onr"))


def rel9(t):
    e = t.entities
    r = _first_review(e).join(e.review_order.select("nr", "person"), F.col("rnr") == F.col("nr")).select("person")
    p = e.person.join(r, F.col("nr") == F.col("person"), "left_semi")
    r2 = e.review_core.join(e.review_order.select("nr", "person"), "nr")
    out = p.select(F.col("nr").alias("person"), "name", "mbox_sha1sum", "country").join(r2, "person")
    return out.select("person", "name", "mbox_sha1sum", "country", F.col("nr").alias("review"), "product", "title")


def rel10(t, nr=P, country=17, max_days=3, date="1998-01-01"):
    e = t.entities
    v = e.vendor.where(F.col("country") == country).select(F.col("nr").alias("vendor"))
    o = e.offer.where((F.col("deliveryDays") <= max_days) & (F.col("validTo") > F.lit(date).cast("timestamp_ntz")))
    o = o.where(F.col("product") == nr).join(v, "vendor", "left_semi")
    return slice_(o, project=["nr", "price"], distinct=True, order=["price", "nr"], limit=10)


def rel11(t):
    e = t.entities
    o = e.offer.join(_first_offer(e), F.col("nr") == F.col("onr"))
    p = e.product.select(F.col("nr").alias("product"), "producer")
    return o.join(p, "product").select(
        "product", "producer", "vendor", "price", "validFrom", "validTo", "deliveryDays", "offerWebpage", "publisher", "publishDate"
    )


def rel12(t):
    e = t.entities
    o = e.offer.join(_first_offer(e), F.col("nr") == F.col("onr"))
    p = e.product.select(F.col("nr").alias("product"), F.col("label").alias("productlabel"))
    v = e.vendor.select(F.col("nr").alias("vendor"), F.col("label").alias("vendorname"), F.col("homepage").alias("vendorhomepage"))
    out = o.join(p, "product").join(v, "vendor")
    return out.select(
        F.col("product").alias("productNr"), "productlabel", "vendorname", "vendorhomepage",
        F.col("offerWebpage").alias("offerURL"), "price", "deliveryDays", "validTo",
    )
