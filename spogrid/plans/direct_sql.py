"""Oracles of queries that join whole offers or reviews, over the input tables themselves.

An offer or review is one row of ``lineitem`` (rows of equal keys are one), so what
is several triple patterns on one subject is a single row here, without the
list of all triples.
"""

from __future__ import annotations

_NR = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d'))"""

_OFFERS = f"""o AS (
  SELECT DISTINCT 'offer/' || {_NR} AS offer, 'product/' || CAST(l_partkey AS VARCHAR) AS product, 'vendor/' || CAST(l_suppkey AS VARCHAR) AS vendor,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_linenumber AS BIGINT) AS days, l_shipdate AS valid_to, l_partkey, l_suppkey
  FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_linenumber IS NOT NULL AND l_shipdate IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL)"""

_REVIEWS = f"""r AS (
  SELECT DISTINCT 'review/' || {_NR} AS review, l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS rating1,
    CASE WHEN l_tax > 0.04 THEN CAST(floor(l_quantity) AS BIGINT) % 10 + 1 END AS rating2, l_quantity > 25 AS rated4
  FROM lineitem WHERE l_returnflag = 'R')"""

_PRODUCT = {
    "rdfs:label": "p_name", "rdf:type": "'type/' || p_type", "rdfs:comment": "concat_ws(' ', p_name, 'by', p_brand)",
    "shop:producer": "'producer/' || b", "dc:publisher": "'producer/' || b",
    "shop:productPropertyNumeric1": "p_size", "shop:productPropertyNumeric2": "p_partkey % 500", "shop:productPropertyNumeric3": "(p_partkey * 7) % 500",
    "shop:productPropertyNumeric4": "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) * 10 END",
    "shop:productPropertyTextual1": "concat_ws(' ', p_brand, p_name)", "shop:productPropertyTextual2": "concat_ws(' ', p_type, p_name)",
    "shop:productPropertyTextual3": "concat_ws(' ', p_name, 'size', CAST(p_size AS VARCHAR))",
    "shop:productPropertyTextual4": "CASE WHEN p_partkey % 4 = 0 THEN p_name || ' extra' END",
    "shop:productPropertyTextual5": "CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' special' END",
}

SQL = {
    "project": f"WITH {_OFFERS} SELECT product, vendor FROM o",
    "filter_compare": f"""WITH {_OFFERS} SELECT offer, CAST(price AS VARCHAR) AS price FROM o
WHERE CAST(price AS DOUBLE) > 50000 AND valid_to >= TIMESTAMP '2000-01-01' AND days <> 3""",
    "filter_var_eq": f"WITH {_OFFERS} SELECT offer, vendor AS v, vendor AS pub FROM o",
    "bgp_star": f"WITH {_OFFERS} SELECT offer, product, vendor, CAST(price AS VARCHAR) AS price FROM o",
    "group_join": f"WITH {_OFFERS} SELECT offer AS o, product AS p, vendor AS v, CAST(price AS VARCHAR) AS price FROM o",
    "bgp_snowflake": f"""WITH {_OFFERS}
SELECT offer, 'nation/' || CAST(CAST(split_part(p_brand, '#', 2) AS BIGINT) % 25 AS VARCHAR) AS pcountry,
  'nation/' || CAST(s_nationkey AS VARCHAR) AS vcountry, 'type/' || p_type AS type
FROM o JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE p_type IS NOT NULL AND s_nationkey IS NOT NULL""",
    "path_seq": f"""WITH {_REVIEWS}
SELECT review, 'nation/' || CAST(c_nationkey AS VARCHAR) AS country
FROM (SELECT DISTINCT review, l_orderkey FROM r) x JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IS NOT NULL""",
    "fn_cast": f"WITH {_OFFERS} SELECT offer, price AS priceDec, days AS ddInt, CAST(NULL AS BIGINT) AS bad FROM o",
    "fn_arith": f"""WITH {_OFFERS} SELECT offer, CAST(days AS DOUBLE) * 2 + 1 AS a, CAST(days AS DOUBLE) - 7 AS b,
  CAST(CAST(price * 100 AS BIGINT) AS DOUBLE) / CAST(days AS DOUBLE) AS c FROM o""",
    "anti_join": f"""WITH {_REVIEWS} SELECT 'product/' || CAST(p_partkey AS VARCHAR) AS p, p_name AS label FROM part
WHERE p_name IS NOT NULL AND p_partkey NOT IN (SELECT l_partkey FROM r WHERE rated4 AND l_partkey IS NOT NULL)""",
    "describe": f"""WITH p AS (SELECT *, CAST(CAST(split_part(p_brand, '#', 2) AS BIGINT) AS VARCHAR) AS b FROM part WHERE p_type = 'PROMO'),
x AS (SELECT p_partkey, unnest([{", ".join(f"{{'p': '{k}', 'o': CAST({v} AS VARCHAR)}}" for k, v in _PRODUCT.items())}, {{'p': 'rdf:type', 'o': 'shop:Product'}}]) AS t FROM p),
f AS (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), ['size' || CAST(p_size % 10 AS VARCHAR)])) AS f FROM p)
SELECT 'product/' || CAST(p_partkey AS VARCHAR) AS sub, t.p AS pred, t.o AS obj FROM x WHERE t.o IS NOT NULL
UNION SELECT 'product/' || CAST(p_partkey AS VARCHAR), 'shop:productFeature', 'feature/' || f FROM f WHERE f <> ''""",
    "explore7": f"""WITH {_OFFERS}, {_REVIEWS},
ox AS (SELECT offer, CAST(price AS VARCHAR) AS price, vendor, s_name AS vendorTitle FROM o JOIN supplier ON s_suppkey = l_suppkey
  WHERE l_partkey = 10 AND s_nationkey = 21 AND valid_to > TIMESTAMP '1998-01-01'),
rx AS (SELECT review, 'review of product ' || CAST(l_partkey AS VARCHAR) AS revTitle, 'person/' || CAST(c_custkey AS VARCHAR) AS reviewer, c_name AS revName,
    CAST(rating1 AS VARCHAR) AS rating1, CAST(rating2 AS VARCHAR) AS rating2
  FROM r JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_partkey = 10)
SELECT p_name AS productLabel, offer, price, vendor, vendorTitle, review, revTitle, reviewer, revName, rating1, rating2
FROM part LEFT JOIN ox ON TRUE LEFT JOIN rx ON TRUE WHERE p_partkey = 10""",
}

_CO_REVIEWED = f"""{_REVIEWS},
c AS MATERIALIZED (SELECT DISTINCT l_partkey AS p, o_custkey AS c FROM r JOIN orders ON o_orderkey = l_orderkey)"""

_BRAND = "CAST(split_part(p_brand, '#', 2) AS BIGINT)"

SQL |= {
    "path_star": f"""WITH RECURSIVE n(a) AS (SELECT 1 UNION SELECT n_nationkey FROM nation JOIN n ON n_nationkey * n_nationkey % 25 = a)
SELECT 'person/' || CAST(c_custkey AS VARCHAR) AS x FROM customer WHERE c_nationkey IN (SELECT a FROM n)
UNION ALL SELECT 'vendor/' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey IN (SELECT a FROM n)
UNION ALL SELECT DISTINCT 'producer/' || CAST({_BRAND} AS VARCHAR) FROM part WHERE {_BRAND} % 25 IN (SELECT a FROM n)""",
    "path_plus": f"""WITH RECURSIVE {_CO_REVIEWED},
reach(p) AS (SELECT y.p FROM c x JOIN c y ON y.c = x.c WHERE x.p = 10 UNION SELECT y.p FROM reach JOIN c x ON x.p = reach.p JOIN c y ON y.c = x.c)
SELECT 'product/' || CAST(p AS VARCHAR) AS product FROM reach""",
    "path_opt": f"""WITH {_REVIEWS} SELECT review FROM (SELECT DISTINCT review, l_partkey FROM r) x JOIN part ON p_partkey = l_partkey WHERE {_BRAND} = 12""",
    "path_all_pairs": """WITH RECURSIVE n(a, b) AS (SELECT n_nationkey, n_nationkey * n_nationkey % 25 FROM nation WHERE n_nationkey IS NOT NULL
  UNION SELECT a, n_nationkey * n_nationkey % 25 FROM n JOIN nation ON n_nationkey = b)
SELECT 'nation/' || CAST(a AS VARCHAR) AS a, 'nation/' || CAST(b AS VARCHAR) AS b FROM n""",
    "path_negated": f"""WITH p AS (SELECT *, CAST({_BRAND} AS VARCHAR) AS b FROM part WHERE p_partkey = 10), {_OFFERS},
x AS (SELECT unnest([{", ".join(f"{{'p': '{k}', 'o': CAST({v} AS VARCHAR)}}" for k, v in _PRODUCT.items())}]) AS t FROM p)
SELECT t.o AS x FROM x WHERE t.o IS NOT NULL AND t.p <> 'rdf:type' UNION ALL SELECT offer FROM o WHERE l_partkey = 10""",
    "path_between": f"""WITH RECURSIVE {_CO_REVIEWED},
w(p, d) AS (SELECT DISTINCT y.p, 1 FROM c x JOIN c y ON y.c = x.c WHERE x.p = 10
  UNION SELECT y.p, d + 1 FROM w JOIN c x ON x.p = w.p JOIN c y ON y.c = x.c WHERE d < 8)
SELECT 'product/10' AS s, 'product/20' AS o, CAST(min(d) AS INT) AS steps FROM w WHERE p = 20 HAVING count(*) > 0""",
}

_TEXT = """SELECT CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 6 END AS k, {0} AS v FROM part"""
_FOUR = _TEXT.format("(p_partkey % 4 = 0 AND p_name IS NOT NULL)")
_FIVE = _TEXT.format("(p_partkey % 3 = 0 AND p_brand IS NOT NULL)")
_GRADED = f"""g AS (
  SELECT DISTINCT 'review/' || {_NR} AS review, 'type/' || p_type AS t, 'person/' || CAST(o_custkey AS VARCHAR) AS c,
    CAST(CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_quantity) AS BIGINT) % 7 + 1 END AS VARCHAR) AS g
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"""
_SUMS = "count(*) AS n, count(DISTINCT c) AS people"

SQL |= {
    "intersect_set": f"{_FOUR} INTERSECT {_FIVE}",
    "intersect_bag": f"{_FOUR} INTERSECT ALL {_FIVE}",
    "except_set": f"{_FOUR} EXCEPT {_FIVE}",
    "except_bag": f"{_FOUR} EXCEPT ALL {_FIVE}",
    "agg_rollup": f"WITH {_GRADED} SELECT t, g, CAST(grouping(t, g) AS BIGINT) AS grouping, {_SUMS} FROM g GROUP BY ROLLUP (t, g)",
    "agg_cube": f"WITH {_GRADED} SELECT t, g, CAST(grouping(t, g) AS BIGINT) AS grouping, {_SUMS} FROM g GROUP BY CUBE (t, g)",
    "agg_grouping_sets": f"WITH {_GRADED} SELECT t, g, CAST(grouping(t, g) AS BIGINT) AS grouping, {_SUMS} FROM g GROUP BY GROUPING SETS ((t), (g))",
    "global_rank": f"""WITH {_OFFERS} SELECT offer AS o, rank() OVER (ORDER BY days) AS by_days, dense_rank() OVER (ORDER BY days) AS by_days_dense,
  rank() OVER (ORDER BY days, price) AS by_price, dense_rank() OVER (ORDER BY days, price) AS by_price_dense FROM o""",
}
