"""DuckDB oracles of the business-intelligence workload over ``triples``."""

from __future__ import annotations

from spogrid.plans.oracle_base import with_common

_PROMO = "t.pred = 'rdf:type' AND t.obj = 'type/PROMO' AND t.kind = 'iri'"
_CENTS = "CAST(CAST(pr.obj AS DECIMAL(18,2)) * 100 AS BIGINT)"

BI1 = """
SELECT pt.sub AS productType, count(rf.sub) AS reviewCount
FROM triples pt
JOIN triples p ON p.pred = 'rdf:type' AND p.obj = pt.sub
JOIN triples pr ON pr.sub = p.sub AND pr.pred = 'shop:producer'
JOIN triples pc ON pc.sub = pr.obj AND pc.pred = 'shop:country' AND pc.obj = 'nation/3' AND pc.kind = 'iri'
JOIN triples rf ON rf.pred = 'shop:reviewFor' AND rf.obj = p.sub
JOIN triples rr ON rr.sub = rf.sub AND rr.pred = 'rev:reviewer'
JOIN triples rc ON rc.sub = rr.obj AND rc.pred = 'shop:country' AND rc.obj = 'nation/7' AND rc.kind = 'iri'
WHERE pt.pred = 'rdf:type' AND pt.obj = 'shop:ProductType' AND pt.kind = 'iri'
GROUP BY pt.sub
ORDER BY reviewCount DESC, productType LIMIT 10
"""

BI2 = """
SELECT s.otherProduct, s.sameFeatures FROM (
  SELECT o.sub AS otherProduct, count(o.obj) AS sameFeatures
  FROM triples f JOIN triples o ON o.pred = 'shop:productFeature' AND o.obj = f.obj
  WHERE f.sub = 'product/10' AND f.pred = 'shop:productFeature'
  GROUP BY o.sub) s
JOIN triples t ON t.sub = s.otherProduct AND t.pred = 'rdf:type' AND t.obj = 'shop:Product' AND t.kind = 'iri'
WHERE s.otherProduct <> 'product/10'
ORDER BY sameFeatures DESC, otherProduct LIMIT 10
"""


def _bi3_window(lo: str, hi: str, name: str, having: str = "") -> str:
    return f"""
  SELECT rf.obj AS product, count(rf.sub) AS {name}
  FROM triples rf JOIN triples d ON d.sub = rf.sub AND d.pred = 'dc:date'
  WHERE rf.pred = 'shop:reviewFor' AND d.ts >= TIMESTAMP '{lo}' AND d.ts < TIMESTAMP '{hi}'
  GROUP BY rf.obj {having}"""


BI3 = f"""
SELECT a.product, CAST(a.monthCount AS DOUBLE) / b.monthBeforeCount AS ratio
FROM ({_bi3_window("1997-01-29", "1997-02-26", "monthCount")}) a
JOIN ({_bi3_window("1997-01-01", "1997-01-29", "monthBeforeCount", "HAVING count(rf.sub) > 0")}) b
  ON a.product = b.product
ORDER BY ratio DESC, product LIMIT 10
"""

_OFFERS = f"""offers AS (
  SELECT op.sub AS offer, t.sub AS product, {_CENTS} AS cents
  FROM triples t
  JOIN triples op ON op.pred = 'shop:product' AND op.obj = t.sub
  JOIN triples pr ON pr.sub = op.sub AND pr.pred = 'shop:price'
  WHERE {_PROMO})"""

BI4 = """
SELECT feature,
       (CAST(sw AS DOUBLE) / cw) / (CAST(ts - sw AS DOUBLE) / (tc - cw)) AS priceRatio
FROM (SELECT f.obj AS feature, sum(o.cents) AS sw, count(*) AS cw
      FROM offers o JOIN triples f ON f.sub = o.product AND f.pred = 'shop:productFeature'
      GROUP BY f.obj) w,
     (SELECT sum(cents) AS ts, count(*) AS tc FROM offers) tot
WHERE tc - cw > 0
ORDER BY priceRatio DESC, feature LIMIT 10
"""

BI5 = f"""
WITH a AS (
  SELECT rc.obj AS country, t.sub AS product, count(rf.sub) AS nrOfReviews
  FROM triples t
  JOIN triples rf ON rf.pred = 'shop:reviewFor' AND rf.obj = t.sub
  JOIN triples rr ON rr.sub = rf.sub AND rr.pred = 'rev:reviewer'
  JOIN triples rc ON rc.sub = rr.obj AND rc.pred = 'shop:country'
  WHERE {_PROMO}
  GROUP BY rc.obj, t.sub),
m AS (SELECT country, max(nrOfReviews) AS maxReviews FROM a GROUP BY country),
b AS (SELECT product, (CAST(sum(cents) AS DOUBLE) / count(*)) / 100 AS avgPrice FROM offers GROUP BY product)
SELECT a.country, a.product, a.nrOfReviews, b.avgPrice
FROM a JOIN m ON a.country = m.country AND a.nrOfReviews = m.maxReviews
JOIN b ON b.product = a.product
ORDER BY nrOfReviews DESC, country, product
"""


def _bi6_scores(with_reviewer: bool) -> str:
    rv = "JOIN triples rr ON rr.sub = rf.sub AND rr.pred = 'rev:reviewer'" if with_reviewer else ""
    sel = "rr.obj AS reviewer, " if with_reviewer else ""
    return f"""
  SELECT {sel}s.num AS score
  FROM triples p
  JOIN triples rf ON rf.pred = 'shop:reviewFor' AND rf.obj = p.sub
  {rv}
  JOIN triples s ON s.sub = rf.sub AND s.pred IN ('shop:rating1', 'shop:rating2', 'shop:rating3', 'shop:rating4')
  WHERE p.pred = 'shop:producer' AND p.obj = 'producer/3' AND p.kind = 'iri'"""


BI6 = f"""
SELECT reviewer, reviewerAvgScore FROM (
  SELECT reviewer, sum(score) / count(score) AS reviewerAvgScore
  FROM ({_bi6_scores(True)}) x GROUP BY reviewer) per,
  (SELECT sum(score) / count(score) AS avgScore FROM ({_bi6_scores(False)}) y) g
WHERE reviewerAvgScore > avgScore * 1.5
"""

BI7 = f"""
WITH top AS (
  SELECT t.sub AS product, count(op.sub) AS offerCount
  FROM triples t JOIN triples op ON op.pred = 'shop:product' AND op.obj = t.sub
  WHERE {_PROMO}
  GROUP BY t.sub
  ORDER BY offerCount DESC, product LIMIT 1000)
SELECT product FROM top
WHERE NOT EXISTS (
  SELECT 1 FROM triples op
  JOIN triples v ON v.sub = op.sub AND v.pred = 'shop:vendor'
  JOIN triples vc ON vc.sub = v.obj AND vc.pred = 'shop:country' AND vc.obj = 'nation/15' AND vc.kind = 'iri'
  WHERE op.pred = 'shop:product' AND op.obj = top.product)
"""

BI8 = f"""
WITH o AS (
  SELECT op.sub AS offer, t.sub AS product, v.obj AS vendor, {_CENTS} AS cents
  FROM triples t
  JOIN triples op ON op.pred = 'shop:product' AND op.obj = t.sub
  JOIN triples v ON v.sub = op.sub AND v.pred = 'shop:vendor'
  JOIN triples pr ON pr.sub = op.sub AND pr.pred = 'shop:price'
  WHERE {_PROMO}),
a AS (SELECT product, sum(cents) AS s, count(*) AS c FROM o GROUP BY product),
b AS (SELECT o.vendor, count(*) FILTER (WHERE o.cents * a.c < a.s) AS belowAvg, count(*) AS offerCount
      FROM o JOIN a USING (product) GROUP BY o.vendor)
SELECT vendor, CAST(belowAvg AS DOUBLE) / offerCount AS cheapExpensiveRatio
FROM b WHERE belowAvg > 0
ORDER BY cheapExpensiveRatio DESC, vendor LIMIT 10
"""

SQL = {
    "bi1": with_common(BI1),
    "bi2": with_common(BI2),
    "bi3": with_common(BI3),
    "bi4": with_common(BI4, _OFFERS),
    "bi5": with_common(BI5, _OFFERS),
    "bi6": with_common(BI6),
    "bi7": with_common(BI7),
    "bi8": with_common(BI8),
}
