"""DuckDB oracles of the explore workload, written as SQL self-joins of ``triples``."""

from __future__ import annotations

from spogrid.plans.oracle_base import with_common

_TYPE = "JOIN triples {a} ON {a}.sub = {s} AND {a}.pred = 'rdf:type' AND {a}.obj = '{c}' AND {a}.kind = 'iri'"
_FEAT = (
    "JOIN triples {a} ON {a}.sub = {s} AND {a}.pred = 'shop:productFeature' AND {a}.obj = '{f}' AND {a}.kind = 'iri'"
)


def _j(a: str, s: str, pred: str) -> str:
    return f"JOIN triples {a} ON {a}.sub = {s} AND {a}.pred = '{pred}'"


def _lj(a: str, s: str, pred: str) -> str:
    return f"LEFT JOIN triples {a} ON {a}.sub = {s} AND {a}.pred = '{pred}'"


EXPLORE1 = f"""
SELECT DISTINCT l.sub AS product, l.obj AS label
FROM triples l
{_TYPE.format(a="t", s="l.sub", c="type/PROMO")}
{_FEAT.format(a="f1", s="l.sub", f="feature/cold")}
{_FEAT.format(a="f2", s="l.sub", f="feature/gear")}
{_j("v", "l.sub", "shop:productPropertyNumeric1")}
WHERE l.pred = 'rdfs:label' AND v.num > 5
ORDER BY label, product LIMIT 10
"""

EXPLORE2 = f"""
SELECT m.*, o4.obj AS propertyTextual4, o5.obj AS propertyTextual5, n4.obj AS propertyNumeric4
FROM (
  SELECT l.obj AS label, c.obj AS comment, pl.obj AS producer, fl.obj AS productFeature,
         t1.obj AS propertyTextual1, t2.obj AS propertyTextual2, t3.obj AS propertyTextual3,
         n1.obj AS propertyNumeric1, n2.obj AS propertyNumeric2
  FROM triples l
  {_j("c", "l.sub", "rdfs:comment")}
  {_j("pr", "l.sub", "shop:producer")}
  {_j("pl", "pr.obj", "rdfs:label")}
  JOIN triples pub ON pub.sub = l.sub AND pub.pred = 'dc:publisher' AND pub.obj = pr.obj
  {_j("f", "l.sub", "shop:productFeature")}
  {_j("fl", "f.obj", "rdfs:label")}
  {_j("t1", "l.sub", "shop:productPropertyTextual1")}
  {_j("t2", "l.sub", "shop:productPropertyTextual2")}
  {_j("t3", "l.sub", "shop:productPropertyTextual3")}
  {_j("n1", "l.sub", "shop:productPropertyNumeric1")}
  {_j("n2", "l.sub", "shop:productPropertyNumeric2")}
  WHERE l.sub = 'product/10' AND l.pred = 'rdfs:label') m
LEFT JOIN (SELECT obj FROM triples WHERE sub = 'product/10' AND pred = 'shop:productPropertyTextual4') o4 ON TRUE
LEFT JOIN (SELECT obj FROM triples WHERE sub = 'product/10' AND pred = 'shop:productPropertyTextual5') o5 ON TRUE
LEFT JOIN (SELECT obj FROM triples WHERE sub = 'product/10' AND pred = 'shop:productPropertyNumeric4') n4 ON TRUE
"""

EXPLORE3 = f"""
SELECT l.sub AS product, l.obj AS label
FROM triples l
{_TYPE.format(a="t", s="l.sub", c="type/PROMO")}
{_FEAT.format(a="f1", s="l.sub", f="feature/cold")}
{_j("n1", "l.sub", "shop:productPropertyNumeric1")}
{_j("n3", "l.sub", "shop:productPropertyNumeric3")}
WHERE l.pred = 'rdfs:label' AND n1.num > 5 AND n3.num < 450
  AND NOT EXISTS (
    SELECT 1 FROM triples g {_j("gl", "g.sub", "rdfs:label")}
    WHERE g.sub = l.sub AND g.pred = 'shop:productFeature' AND g.obj = 'feature/gear' AND g.kind = 'iri')
ORDER BY label, product LIMIT 10
"""


def _explore4_branch(f: str, pred: str, bound: int) -> str:
    return f"""
  SELECT l.sub AS product, l.obj AS label, tx.obj AS propertyTextual
  FROM triples l
  {_TYPE.format(a="t", s="l.sub", c="type/PROMO")}
  {_FEAT.format(a="f1", s="l.sub", f="feature/cold")}
  {_FEAT.format(a="f2", s="l.sub", f=f)}
  {_j("tx", "l.sub", "shop:productPropertyTextual1")}
  {_j("n", "l.sub", pred)}
  WHERE l.pred = 'rdfs:label' AND n.num > {bound}"""


EXPLORE4 = f"""
SELECT DISTINCT product, label, propertyTextual FROM (
{_explore4_branch("feature/gear", "shop:productPropertyNumeric1", 5)}
  UNION ALL
{_explore4_branch("feature/widget", "shop:productPropertyNumeric2", 3)}
) u
ORDER BY label, product, propertyTextual LIMIT 10 OFFSET 5
"""

EXPLORE5 = f"""
SELECT DISTINCT f.sub AS product, l.obj AS productLabel
FROM triples pf
JOIN triples f ON f.pred = 'shop:productFeature' AND f.obj = pf.obj
{_j("o1", "pf.sub", "shop:productPropertyNumeric1")}
{_j("s1", "f.sub", "shop:productPropertyNumeric1")}
{_j("o2", "pf.sub", "shop:productPropertyNumeric2")}
{_j("s2", "f.sub", "shop:productPropertyNumeric2")}
{_j("l", "f.sub", "rdfs:label")}
WHERE pf.sub = 'product/10' AND pf.pred = 'shop:productFeature' AND f.sub <> 'product/10'
  AND s1.num - o1.num < 10 AND s1.num - o1.num > -10
  AND s2.num - o2.num < 50 AND s2.num - o2.num > -50
ORDER BY productLabel, product LIMIT 5
"""

EXPLORE6 = f"""
SELECT l.sub AS product, l.obj AS label
FROM triples l
{_TYPE.format(a="t", s="l.sub", c="shop:Product")}
WHERE l.pred = 'rdfs:label' AND regexp_matches(l.obj, 'widget')
"""

EXPLORE7 = f"""
SELECT productLabel, offer, price, vendor, vendorTitle, review, revTitle, reviewer, revName, rating1, rating2
FROM (SELECT obj AS productLabel FROM triples WHERE sub = 'product/10' AND pred = 'rdfs:label') m
LEFT JOIN (
  SELECT op.sub AS offer, pr.obj AS price, v.obj AS vendor, vl.obj AS vendorTitle
  FROM triples op
  {_j("pr", "op.sub", "shop:price")}
  {_j("v", "op.sub", "shop:vendor")}
  {_j("vl", "v.obj", "rdfs:label")}
  JOIN triples vc ON vc.sub = v.obj AND vc.pred = 'shop:country' AND vc.obj = 'nation/21' AND vc.kind = 'iri'
  JOIN triples pu ON pu.sub = op.sub AND pu.pred = 'dc:publisher' AND pu.obj = v.obj
  {_j("d", "op.sub", "shop:validTo")}
  WHERE op.pred = 'shop:product' AND op.obj = 'product/10' AND op.kind = 'iri'
    AND d.ts > TIMESTAMP '1998-01-01') o ON TRUE
LEFT JOIN (
  SELECT rf.sub AS review, rt.obj AS revTitle, rr.obj AS reviewer, rn.obj AS revName,
         r1.obj AS rating1, r2.obj AS rating2
  FROM triples rf
  {_j("rr", "rf.sub", "rev:reviewer")}
  {_j("rn", "rr.obj", "foaf:name")}
  {_j("rt", "rf.sub", "dc:title")}
  {_lj("r1", "rf.sub", "shop:rating1")}
  {_lj("r2", "rf.sub", "shop:rating2")}
  WHERE rf.pred = 'shop:reviewFor' AND rf.obj = 'product/10' AND rf.kind = 'iri') r ON TRUE
"""

EXPLORE8 = f"""
SELECT title, text, reviewDate, reviewer, reviewerName, rating1, rating2, rating3, rating4 FROM (
  SELECT rf.sub AS review, t.obj AS title, x.obj AS text, d.obj AS reviewDate, d.ts AS date_ts,
         rr.obj AS reviewer, rn.obj AS reviewerName,
         r1.obj AS rating1, r2.obj AS rating2, r3.obj AS rating3, r4.obj AS rating4
  FROM triples rf
  {_j("t", "rf.sub", "dc:title")}
  {_j("x", "rf.sub", "rev:text")}
  {_j("d", "rf.sub", "shop:reviewDate")}
  {_j("rr", "rf.sub", "rev:reviewer")}
  {_j("rn", "rr.obj", "foaf:name")}
  {_lj("r1", "rf.sub", "shop:rating1")}
  {_lj("r2", "rf.sub", "shop:rating2")}
  {_lj("r3", "rf.sub", "shop:rating3")}
  {_lj("r4", "rf.sub", "shop:rating4")}
  WHERE rf.pred = 'shop:reviewFor' AND rf.obj = 'product/10' AND rf.kind = 'iri'
    AND (lower(coalesce(x.lang, '')) = 'en' OR lower(coalesce(x.lang, '')) LIKE 'en-%')) q
ORDER BY date_ts DESC, review LIMIT 20
"""

_FIRST_REVIEW = (
    "param AS (SELECT min(sub) AS id FROM triples WHERE pred = 'shop:reviewFor' AND obj = 'product/10' AND kind = 'iri')"
)
_FIRST_OFFER = (
    "param AS (SELECT min(sub) AS id FROM triples WHERE pred = 'shop:product' AND obj = 'product/10' AND kind = 'iri')"
)

EXPLORE9 = """
SELECT sub, pred, obj FROM triples
WHERE sub IN (SELECT t.obj FROM triples t JOIN param ON t.sub = param.id WHERE t.pred = 'rev:reviewer')
"""

EXPLORE10 = f"""
SELECT offer, price FROM (
  SELECT DISTINCT ov.sub AS offer, pr.obj AS price
  FROM triples ov
  JOIN triples pu ON pu.sub = ov.sub AND pu.pred = 'dc:publisher' AND pu.obj = ov.obj
  JOIN triples vc ON vc.sub = ov.obj AND vc.pred = 'shop:country' AND vc.obj = 'nation/17' AND vc.kind = 'iri'
  JOIN triples po ON po.sub = ov.sub AND po.pred = 'shop:product' AND po.obj = 'product/10' AND po.kind = 'iri'
  {_j("dd", "ov.sub", "shop:deliveryDays")}
  {_j("pr", "ov.sub", "shop:price")}
  {_j("d", "ov.sub", "shop:validTo")}
  WHERE ov.pred = 'shop:vendor' AND dd.num <= 3 AND d.ts > TIMESTAMP '1998-01-01') q
ORDER BY CAST(price AS DOUBLE), offer LIMIT 10
"""

EXPLORE11 = """
SELECT t.pred AS property, t.obj AS hasValue, CAST(NULL AS VARCHAR) AS isValueOf
FROM triples t JOIN param ON t.sub = param.id
UNION ALL
SELECT t.pred, CAST(NULL AS VARCHAR), t.sub FROM triples t JOIN param ON t.obj = param.id
"""

_EXPORT = [
    ("export:product", "productURI"),
    ("export:productlabel", "productlabel"),
    ("export:vendor", "vendorname"),
    ("export:vendorhomepage", "vendorhomepage"),
    ("export:offerURL", "offerURL"),
    ("export:price", "price"),
    ("export:deliveryDays", "deliveryDays"),
    ("export:validuntil", "validTo"),
]

EXPLORE12_CTE = f"""s AS (
  SELECT param.id AS offer, pp.obj AS productURI, pl.obj AS productlabel, vn.obj AS vendorname,
         vh.obj AS vendorhomepage, w.obj AS offerURL, pr.obj AS price, dd.obj AS deliveryDays,
         vt.obj AS validTo
  FROM param
  {_j("pp", "param.id", "shop:product")}
  {_j("pl", "pp.obj", "rdfs:label")}
  {_j("v", "param.id", "shop:vendor")}
  {_j("vn", "v.obj", "rdfs:label")}
  {_j("vh", "v.obj", "foaf:homepage")}
  {_j("w", "param.id", "shop:offerWebpage")}
  {_j("pr", "param.id", "shop:price")}
  {_j("dd", "param.id", "shop:deliveryDays")}
  {_j("vt", "param.id", "shop:validTo")})"""

_EXPORT_TYPE = {
    "productlabel": "'xsd:string'", "vendorname": "'xsd:string'", "price": "'shop:USD'", "deliveryDays": "'xsd:integer'",
    "validTo": "'xsd:dateTime'",
}

EXPLORE12 = (
    "SELECT DISTINCT sub, pred, obj, CASE WHEN dt IS NULL THEN 'iri' ELSE 'lit' END AS kind, dt, CAST(NULL AS VARCHAR) AS lang FROM (\n  "
    + "\n  UNION ALL ".join(f"SELECT offer AS sub, '{p}' AS pred, {v} AS obj, {_EXPORT_TYPE.get(v, 'NULL')} AS dt FROM s" for p, v in _EXPORT)
    + ") c WHERE obj IS NOT NULL"
)

SQL = {
    "explore1": with_common(EXPLORE1),
    "explore2": with_common(EXPLORE2),
    "explore3": with_common(EXPLORE3),
    "explore4": with_common(EXPLORE4),
    "explore5": with_common(EXPLORE5),
    "explore6": with_common(EXPLORE6),
    "explore7": with_common(EXPLORE7),
    "explore8": with_common(EXPLORE8),
    "explore9": with_common(EXPLORE9, _FIRST_REVIEW),
    "explore10": with_common(EXPLORE10),
    "explore11": with_common(EXPLORE11, _FIRST_OFFER),
    "explore12": with_common(EXPLORE12, _FIRST_OFFER + ",\n" + EXPLORE12_CTE),
}
