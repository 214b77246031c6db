"""DuckDB oracles of the questions on the entity tables.

Written from the questions over the input tables, not over the derived
entities, so they check the entities too.
"""

from __future__ import annotations

# Offers are line items, reviews the returned ones.
_KEY = (
    "concat_ws('-', {0}.l_orderkey, {0}.l_linenumber, {0}.l_partkey, {0}.l_suppkey, "
    "CAST(round({0}.l_extendedprice * 100) AS BIGINT), strftime({0}.l_shipdate, '%Y%m%d'))"
)
_BRAND = "CAST(regexp_extract({0}.p_brand, '([0-9]+)$', 1) AS BIGINT)"
_RATING2 = "CASE WHEN {0}.l_tax > 0.04 THEN CAST(floor({0}.l_quantity) AS BIGINT) % 10 + 1 END"
_RATING3 = "CASE WHEN {0}.l_linestatus = 'O' THEN CAST(floor({0}.l_quantity) AS BIGINT) % 7 + 1 END"


def _features(t: str) -> str:
    """Words of the name and the last digit of the size."""
    words = f"list_append(string_split({t}.p_name, ' '), concat('size', {t}.p_size % 10))"
    return f"list_distinct(list_filter({words}, lambda f: length(f) > 0))"


def _has(feature: str, t: str = "part") -> str:
    return f"list_has({_features(t)}, '{feature}')"


_TOP = "ORDER BY p_name, p_partkey LIMIT 10"
_SMALLEST = f"(SELECT min({_KEY.format('m')}) FROM lineitem m WHERE m.l_partkey = 10"

SQL = {
    "rel1": f"""SELECT p_partkey AS nr, p_name AS label FROM part
WHERE p_size > 5 AND p_type = 'PROMO' AND {_has('gear')} AND {_has('cold')} {_TOP}""",
    "rel2": f"""SELECT p_name AS label, concat(p_name, ' by ', p_brand) AS comment, {_BRAND.format('part')} AS producer,
  unnest({_features('part')}) AS productFeature, concat(p_brand, ' ', p_name) AS propertyTex1,
  concat(p_type, ' ', p_name) AS propertyTex2, concat(p_name, ' size ', p_size) AS propertyTex3,
  CAST(p_size AS BIGINT) AS propertyNum1, p_partkey % 500 AS propertyNum2,
  if(p_partkey % 4 = 0, concat(p_name, ' extra'), NULL) AS propertyTex4,
  if(p_partkey % 3 = 0, concat(p_brand, ' special'), NULL) AS propertyTex5,
  if(p_partkey % 2 = 0, CAST(p_size AS BIGINT) * 10, NULL) AS propertyNum4
FROM part WHERE p_partkey = 10""",
    "rel3": f"""SELECT p_partkey AS nr, p_name AS label FROM part
WHERE p_type = 'PROMO' AND p_partkey * 7 % 500 < 450 AND p_size > 5 AND NOT {_has('gear')} AND {_has('cold')} {_TOP}""",
    "rel4": f"""SELECT p_partkey AS nr, p_name AS label, concat(p_brand, ' ', p_name) AS propertyTex1 FROM part
WHERE {_has('cold')} AND p_type = 'PROMO' AND CASE WHEN p_size > 5 AND {_has('gear')} THEN true
  ELSE p_partkey % 500 > 3 AND {_has('widget')} END {_TOP} OFFSET 5""",
    "rel5": f"""WITH ten AS (SELECT *, {_features('part')} AS f FROM part WHERE p_partkey = 10)
SELECT part.p_partkey AS nr, part.p_name AS label FROM part CROSS JOIN ten
WHERE part.p_partkey <> 10 AND abs(part.p_size - ten.p_size) < 10
  AND abs(part.p_partkey % 500 - ten.p_partkey % 500) < 50 AND list_has_any({_features('part')}, ten.f)
ORDER BY label, nr LIMIT 5""",
    "rel6": "SELECT p_partkey AS nr, p_name AS label FROM part WHERE contains(p_name, 'widget')",
    "rel7": f"""WITH seen AS (
  SELECT l.l_partkey, {_KEY.format('l')} AS rnr, concat('review of product ', l.l_partkey) AS title, c_custkey AS pnnr,
    c_name AS name, CAST(l.l_linenumber AS BIGINT) AS rating1, {_RATING2.format('l')} AS rating2
  FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE l.l_returnflag = 'R'),
sold AS (
  SELECT l.l_partkey, {_KEY.format('l')} AS onr, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price, s_suppkey AS vnr, s_name AS vlabel
  FROM lineitem l JOIN supplier ON s_suppkey = l.l_suppkey WHERE s_nationkey = 21 AND l.l_shipdate > TIMESTAMP '1998-01-01')
SELECT p_name AS label, onr, price, vnr, vlabel, rnr, title, pnnr, name, rating1, rating2
FROM part LEFT JOIN seen ON seen.l_partkey = p_partkey LEFT JOIN sold ON sold.l_partkey = seen.l_partkey
WHERE p_partkey = 10""",
    "rel8": f"""SELECT concat('review of product ', l.l_partkey) AS title, d.text, o_orderdate AS reviewDate, c_custkey AS person,
  c_name AS name, CAST(l.l_linenumber AS BIGINT) AS rating1, {_RATING2.format('l')} AS rating2, {_RATING3.format('l')} AS rating3,
  if(l.l_quantity > 25, 3, NULL) AS rating4
FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN documents d ON d.doc_id = l.l_orderkey % (SELECT count(*) FROM documents) AND d.lang = 'en'
WHERE l.l_returnflag = 'R' AND l.l_partkey = 10 ORDER BY o_orderdate DESC, {_KEY.format('l')} LIMIT 20""",
    "rel9": f"""SELECT c_custkey AS person, c_name AS name, sha1(concat('mailto:', lower(c_name))) AS mbox_sha1sum,
  c_nationkey AS country, {_KEY.format('l')} AS review, l.l_partkey AS product, concat('review of product ', l.l_partkey) AS title
FROM customer JOIN orders o ON o.o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag = 'R' AND EXISTS (
  SELECT 1 FROM lineitem f JOIN orders fo ON fo.o_orderkey = f.l_orderkey
  WHERE fo.o_custkey = c_custkey AND f.l_returnflag = 'R' AND {_KEY.format('f')} = {_SMALLEST} AND m.l_returnflag = 'R'))""",
    "rel10": f"""SELECT {_KEY.format('l')} AS nr, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem l
WHERE l.l_partkey = 10 AND l.l_shipdate > TIMESTAMP '1998-01-01' AND l.l_linenumber < 4
  AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l.l_suppkey AND s_nationkey = 17)
GROUP BY ALL ORDER BY price, nr LIMIT 10""",
    "rel11": f"""SELECT l.l_partkey AS product, {_BRAND.format('part')} AS producer, l.l_suppkey AS vendor,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price, l.l_shipdate - INTERVAL 30 DAY AS validFrom, l.l_shipdate AS validTo,
  CAST(l.l_linenumber AS BIGINT) AS deliveryDays, concat('site/vendor', l.l_suppkey, '/offer/', {_KEY.format('l')}) AS offerWebpage,
  l.l_suppkey AS publisher, CAST(l.l_shipdate - INTERVAL 31 DAY AS DATE) AS publishDate
FROM lineitem l JOIN part ON p_partkey = l.l_partkey WHERE {_KEY.format('l')} = {_SMALLEST})""",
    "rel12": f"""SELECT p_partkey AS productNr, p_name AS productlabel, s_name AS vendorname, concat('site/vendor', s_suppkey) AS vendorhomepage,
  concat('site/vendor', s_suppkey, '/offer/', {_KEY.format('l')}) AS offerURL, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price,
  CAST(l.l_linenumber AS BIGINT) AS deliveryDays, l.l_shipdate AS validTo
FROM lineitem l JOIN supplier ON s_suppkey = l.l_suppkey JOIN part ON p_partkey = l.l_partkey
WHERE {_KEY.format('l')} = {_SMALLEST})""",
}
