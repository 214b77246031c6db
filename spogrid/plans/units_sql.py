"""DuckDB oracles of the single-operator queries."""

from __future__ import annotations

from spogrid.plans.oracle_base import with_common


def _j(a, s, pred):
    return f"JOIN triples {a} ON {a}.sub = {s} AND {a}.pred = '{pred}'"


def _lj(a, s, pred):
    return f"LEFT JOIN triples {a} ON {a}.sub = {s} AND {a}.pred = '{pred}'"


_PRODUCT = "JOIN triples ty ON ty.sub = l.sub AND ty.pred = 'rdf:type' AND ty.obj = 'shop:Product' AND ty.kind = 'iri'"
_LABELS = f"SELECT l.sub AS p, l.obj AS label FROM triples l {_PRODUCT} WHERE l.pred = 'rdfs:label'"
_CENTS = "CAST(CAST({x} AS DECIMAL(18,2)) * 100 AS BIGINT)"

Q: dict[str, str] = {}

# ---------------------------------------------------------------- patterns
Q["tp_predicate"] = "SELECT sub AS s, obj AS o FROM triples WHERE pred = 'rdfs:label'"
Q["tp_subject"] = "SELECT pred AS p, obj AS o FROM triples WHERE sub = 'product/10'"
Q["tp_object"] = "SELECT sub AS s FROM triples WHERE pred = 'shop:country' AND obj = 'nation/7' AND kind = 'iri'"
Q["tp_var_predicate"] = "SELECT sub AS s, pred AS p FROM triples WHERE obj = 'nation/7' AND kind = 'iri'"
Q["tp_blank"] = f"""SELECT a.obj AS product, b.obj AS reviewer FROM triples a {_j("b", "a.sub", "rev:reviewer")}
WHERE a.pred = 'shop:reviewFor'"""
Q["tp_repeat_var"] = "SELECT sub AS x, pred AS p FROM triples WHERE sub = obj AND kind = 'iri'"
Q["tp_review"] = """WITH r AS (SELECT min(sub) AS id FROM triples WHERE pred = 'shop:reviewFor' AND obj = 'product/10' AND kind = 'iri'),
x AS (SELECT obj AS id FROM triples, r WHERE sub = r.id AND pred = 'rev:reviewer')
SELECT sub AS s, pred AS p, obj AS o FROM triples, r WHERE sub = r.id
UNION ALL SELECT sub, pred, obj FROM triples, x WHERE obj = x.id AND kind = 'iri'"""
Q["ordered_diff"] = """WITH e AS (SELECT row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos, p_partkey AS nr, p_name AS label FROM part),
a AS (SELECT row_number() OVER (ORDER BY label, nr) - 1 AS pos, nr, label FROM (
  SELECT p_partkey AS nr, CASE WHEN p_partkey % 50 = 0 THEN upper(p_name) ELSE p_name END AS label FROM part WHERE p_partkey % 70 <> 0))
SELECT pos, e.nr AS expected_nr, e.label AS expected_label, a.nr AS actual_nr, a.label AS actual_label FROM e FULL JOIN a USING (pos)
WHERE e.nr IS DISTINCT FROM a.nr OR e.label IS DISTINCT FROM a.label"""
Q["project"] = f"""SELECT a.obj AS product, b.obj AS vendor FROM triples a {_j("b", "a.sub", "shop:vendor")}
WHERE a.pred = 'shop:product'"""

# ---------------------------------------------------------------- filters
Q["filter_compare"] = f"""SELECT a.sub AS offer, a.obj AS price FROM triples a
{_j("d", "a.sub", "shop:validTo")} {_j("dd", "a.sub", "shop:deliveryDays")}
WHERE a.pred = 'shop:price' AND a.num > 50000 AND d.ts >= TIMESTAMP '2000-01-01' AND dd.num <> 3"""
Q["filter_logic"] = f"""SELECT a.sub AS p, a.obj AS n1, b.obj AS n2, c.obj AS n3 FROM triples a
{_j("b", "a.sub", "shop:productPropertyNumeric2")} {_j("c", "a.sub", "shop:productPropertyNumeric3")}
WHERE a.pred = 'shop:productPropertyNumeric1' AND (a.num > 40 OR b.num < 10) AND NOT (c.num = 0)"""
Q["filter_bound"] = f"""SELECT l.sub AS p, l.obj AS label, t.obj AS t4 FROM triples l {_PRODUCT}
{_j("t", "l.sub", "shop:productPropertyTextual4")} WHERE l.pred = 'rdfs:label'"""
Q["filter_regex"] = f"SELECT * FROM ({_LABELS}) x WHERE regexp_matches(label, '^(red|blue) [a-z]+$')"
Q["filter_like"] = f"SELECT * FROM ({_LABELS}) x WHERE label LIKE '%gear%'"
Q["filter_var_eq"] = f"""SELECT a.sub AS offer, a.obj AS v, b.obj AS pub FROM triples a
JOIN triples b ON b.sub = a.sub AND b.pred = 'dc:publisher' AND b.obj = a.obj AND b.kind = a.kind WHERE a.pred = 'shop:vendor'"""
Q["param_query"] = f"""SELECT l.sub AS product, l.obj AS label FROM triples l
JOIN triples t ON t.sub = l.sub AND t.pred = 'rdf:type' AND t.obj = 'type/PROMO' AND t.kind = 'iri'
JOIN triples f ON f.sub = l.sub AND f.pred = 'shop:productFeature' AND f.obj = 'feature/cold' AND f.kind = 'iri'
{_j("v", "l.sub", "shop:productPropertyNumeric1")} WHERE l.pred = 'rdfs:label' AND v.num > 30"""

# ---------------------------------------------------------------- joins
Q["bgp_star"] = f"""SELECT a.sub AS offer, a.obj AS product, v.obj AS vendor, p.obj AS price FROM triples a
{_j("v", "a.sub", "shop:vendor")} {_j("p", "a.sub", "shop:price")} {_j("d", "a.sub", "shop:deliveryDays")}
{_j("t", "a.sub", "shop:validTo")} WHERE a.pred = 'shop:product'"""
Q["bgp_chain"] = f"""SELECT a.sub AS review, r.obj AS region FROM triples a
{_j("p", "a.obj", "shop:producer")} {_j("c", "p.obj", "shop:country")} {_j("r", "c.obj", "shop:locatedIn")}
WHERE a.pred = 'shop:reviewFor'"""
Q["bgp_snowflake"] = f"""SELECT a.sub AS offer, pc.obj AS pcountry, vc.obj AS vcountry, ty.obj AS type FROM triples a
{_j("v", "a.sub", "shop:vendor")} {_j("pr", "a.obj", "shop:producer")} {_j("pc", "pr.obj", "shop:country")}
{_j("vc", "v.obj", "shop:country")} {_j("ty", "a.obj", "rdf:type")}
JOIN triples tt ON tt.sub = ty.obj AND tt.pred = 'rdf:type' AND tt.obj = 'shop:ProductType' AND tt.kind = 'iri'
WHERE a.pred = 'shop:product'"""
Q["group_join"] = f"""SELECT a.sub AS o, a.obj AS p, v.obj AS v, pr.obj AS price FROM triples a
{_j("v", "a.sub", "shop:vendor")}
JOIN triples pu ON pu.sub = a.sub AND pu.pred = 'dc:publisher' AND pu.obj = v.obj
{_j("pr", "a.sub", "shop:price")} WHERE a.pred = 'shop:product'"""
Q["join_unbound"] = f"""SELECT a.p, a.label, coalesce(a.t, b.t) AS t, b.n FROM
 (SELECT l.sub AS p, l.obj AS label, t.obj AS t FROM triples l {_PRODUCT}
  {_lj("t", "l.sub", "shop:productPropertyTextual4")} WHERE l.pred = 'rdfs:label') a
JOIN (SELECT t.sub AS p, t.obj AS t, n.obj AS n FROM triples t {_j("n", "t.sub", "shop:productPropertyNumeric1")}
      WHERE t.pred = 'shop:productPropertyTextual4') b
  ON a.p = b.p AND (a.t = b.t OR a.t IS NULL OR b.t IS NULL)"""
Q["sequence_join"] = f"""SELECT l.sub AS p, l.obj AS label, f.obj AS f, fl.obj AS flabel FROM triples l {_PRODUCT}
{_j("f", "l.sub", "shop:productFeature")} {_j("fl", "f.obj", "rdfs:label")} WHERE l.pred = 'rdfs:label'"""
Q["optional"] = f"""SELECT t.sub AS p, n.obj AS n4 FROM triples t {_lj("n", "t.sub", "shop:productPropertyNumeric4")}
WHERE t.pred = 'rdf:type' AND t.obj = 'shop:Product' AND t.kind = 'iri'"""
Q["optional_filter"] = """SELECT t.sub AS p, n.obj AS n4 FROM triples t
LEFT JOIN triples n ON n.sub = t.sub AND n.pred = 'shop:productPropertyNumeric4' AND n.num > 200
WHERE t.pred = 'rdf:type' AND t.obj = 'shop:Product' AND t.kind = 'iri'"""
Q["optional_nested"] = """SELECT t.sub AS r, x.r2, x.r3 FROM triples t
LEFT JOIN (SELECT a.sub, a.obj AS r2, b.obj AS r3 FROM triples a
           LEFT JOIN triples b ON b.sub = a.sub AND b.pred = 'shop:rating3'
           WHERE a.pred = 'shop:rating2') x ON x.sub = t.sub
WHERE t.pred = 'rdf:type' AND t.obj = 'rev:Review' AND t.kind = 'iri'"""
Q["optional_disjoint"] = """SELECT r.r, r.rl, c.c, c.cl FROM
 (SELECT t.sub AS r, l.obj AS rl FROM triples t JOIN triples l ON l.sub = t.sub AND l.pred = 'rdfs:label'
  WHERE t.pred = 'rdf:type' AND t.obj = 'shop:Region' AND t.kind = 'iri') r
LEFT JOIN
 (SELECT t.sub AS c, l.obj AS cl FROM triples t JOIN triples l ON l.sub = t.sub AND l.pred = 'rdfs:label'
  WHERE t.pred = 'rdf:type' AND t.obj = 'shop:Country' AND t.kind = 'iri') c
 ON substring(c.cl, 1, 1) = substring(r.rl, 1, 1)"""
Q["semi_join"] = f"""SELECT p, label FROM ({_LABELS}) x
WHERE EXISTS (SELECT 1 FROM triples r WHERE r.pred = 'shop:reviewFor' AND r.obj = x.p)"""
Q["anti_join"] = f"""SELECT p, label FROM ({_LABELS}) x
WHERE NOT EXISTS (SELECT 1 FROM triples r {_j("r4", "r.sub", "shop:rating4")}
                  WHERE r.pred = 'shop:reviewFor' AND r.obj = x.p)"""
Q["anti_optional"] = f"""SELECT p, label FROM ({_LABELS}) x
WHERE NOT EXISTS (SELECT 1 FROM triples t WHERE t.sub = x.p AND t.pred = 'shop:productPropertyTextual4')"""
Q["band_join"] = f"""SELECT DISTINCT f.sub AS p FROM triples pf
JOIN triples f ON f.pred = 'shop:productFeature' AND f.obj = pf.obj
{_j("o1", "pf.sub", "shop:productPropertyNumeric1")} {_j("s1", "f.sub", "shop:productPropertyNumeric1")}
{_j("o2", "pf.sub", "shop:productPropertyNumeric2")} {_j("s2", "f.sub", "shop:productPropertyNumeric2")}
WHERE pf.sub = 'product/10' AND pf.pred = 'shop:productFeature' AND f.sub <> 'product/10'
  AND abs(s1.num - o1.num) < 10 AND abs(s2.num - o2.num) < 50"""
Q["theta_join"] = """SELECT b.sub AS p, a.obj AS pr FROM triples a
JOIN triples b ON b.pred = 'shop:producer' AND b.obj = a.obj
WHERE a.sub = 'product/10' AND a.pred = 'shop:producer' AND b.sub <> 'product/10'"""
Q["self_join"] = """SELECT b.sub AS other, a.obj AS f FROM triples a
JOIN triples b ON b.pred = 'shop:productFeature' AND b.obj = a.obj
WHERE a.sub = 'product/10' AND a.pred = 'shop:productFeature'"""
Q["right_join"] = f"""SELECT x.p, x.label, r.sub AS review
FROM (SELECT sub, obj FROM triples WHERE pred = 'shop:reviewFor') r RIGHT JOIN ({_LABELS}) x ON r.obj = x.p"""
Q["scalar_subquery"] = f"""SELECT o.offer, o.price FROM
 (SELECT sub AS offer, obj AS price, {_CENTS.format(x="obj")} AS cents FROM triples WHERE pred = 'shop:price') o,
 (SELECT sum({_CENTS.format(x="obj")}) AS s, count(*) AS c FROM triples WHERE pred = 'shop:price') g
WHERE o.cents * g.c > g.s"""
Q["interval_lookup"] = """SELECT i.id, b.owner FROM (SELECT c_custkey AS id FROM customer) i
LEFT JOIN (SELECT owner, hi, lag(hi) OVER (ORDER BY owner) AS lo FROM
             (SELECT owner, sum(n) OVER (ORDER BY owner ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
              FROM (SELECT c_nationkey AS owner, count(*) AS n FROM customer GROUP BY c_nationkey) g) h) b
  ON (b.lo IS NULL OR i.id > b.lo) AND i.id <= b.hi"""

# ---------------------------------------------------------------- aggregates
Q["agg_count"] = "SELECT obj AS product, count(sub) AS n FROM triples WHERE pred = 'shop:reviewFor' GROUP BY obj"
Q["agg_avg"] = f"""SELECT a.obj AS product, sum(r.num) / count(r.num) AS avgRating FROM triples a
{_j("r", "a.sub", "shop:rating1")} WHERE a.pred = 'shop:reviewFor' GROUP BY a.obj"""
Q["agg_minmax"] = f"""SELECT a.obj AS vendor, min(p.num) AS minPrice, max(p.num) AS maxPrice FROM triples a
{_j("p", "a.sub", "shop:price")} WHERE a.pred = 'shop:vendor' GROUP BY a.obj"""
Q["agg_having"] = """SELECT obj AS product, count(sub) AS n FROM triples WHERE pred = 'shop:product'
GROUP BY obj HAVING count(sub) >= 35"""
Q["agg_nested"] = f"""SELECT country, max(n) AS maxReviews FROM (
  SELECT c.obj AS country, a.obj AS product, count(a.sub) AS n FROM triples a
  {_j("r", "a.sub", "rev:reviewer")} {_j("c", "r.obj", "shop:country")}
  WHERE a.pred = 'shop:reviewFor' GROUP BY c.obj, a.obj) x GROUP BY country"""
Q["agg_ratio"] = """SELECT r.product, r.nReviews, o.nOffers, CAST(r.nReviews AS DOUBLE) / o.nOffers AS reviewsPerOffer
FROM (SELECT obj AS product, count(*) AS nReviews FROM triples WHERE pred = 'shop:reviewFor' GROUP BY obj) r
JOIN (SELECT obj AS product, count(*) AS nOffers FROM triples WHERE pred = 'shop:product' GROUP BY obj) o
  USING (product)"""
Q["argmax_group"] = f"""WITH per AS (
  SELECT c.obj AS country, a.obj AS vendor, count(a.sub) AS n FROM triples a {_j("c", "a.obj", "shop:country")}
  WHERE a.pred = 'shop:vendor' GROUP BY c.obj, a.obj)
SELECT per.country, per.vendor, per.n FROM per
JOIN (SELECT country, max(n) AS m FROM per GROUP BY country) mx ON mx.country = per.country AND per.n = mx.m"""
Q["agg_union"] = """SELECT a.obj AS product, sum(s.num) / count(s.num) AS avgScore FROM triples a
JOIN triples s ON s.sub = a.sub AND s.pred IN ('shop:rating1', 'shop:rating2', 'shop:rating3', 'shop:rating4')
WHERE a.pred = 'shop:reviewFor' GROUP BY a.obj"""
Q["below_group_avg"] = f"""WITH o AS (
  SELECT a.sub AS offer, a.obj AS product, {_CENTS.format(x="p.obj")} AS cents FROM triples a
  {_j("p", "a.sub", "shop:price")} WHERE a.pred = 'shop:product'),
g AS (SELECT product, sum(cents) AS s, count(*) AS c FROM o GROUP BY product)
SELECT o.product, count(*) FILTER (WHERE o.cents * g.c < g.s) AS belowAvg, count(*) AS offerCount
FROM o JOIN g USING (product) GROUP BY o.product"""
Q["distinct"] = f"""SELECT DISTINCT a.obj AS product, v.obj AS vendor FROM triples a {_j("v", "a.sub", "shop:vendor")}
WHERE a.pred = 'shop:product'"""
Q["word_count"] = """SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(lower(obj), '[^\\p{L}\\p{N}]+')) AS word FROM triples WHERE pred = 'rdfs:label') w
WHERE word <> '' GROUP BY word"""

# ---------------------------------------------------------------- sets and order
Q["union_pad"] = """SELECT sub AS p, obj AS t4, CAST(NULL AS VARCHAR) AS t5 FROM triples WHERE pred = 'shop:productPropertyTextual4'
UNION ALL SELECT sub, NULL, obj FROM triples WHERE pred = 'shop:productPropertyTextual5'"""
Q["union_distinct"] = """SELECT DISTINCT c FROM (
  SELECT a.obj AS c FROM triples a JOIN triples t ON t.sub = a.sub AND t.pred = 'rdf:type' AND t.obj = 'shop:Vendor'
  WHERE a.pred = 'shop:country'
  UNION ALL
  SELECT a.obj FROM triples a JOIN triples t ON t.sub = a.sub AND t.pred = 'rdf:type' AND t.obj = 'shop:Producer'
  WHERE a.pred = 'shop:country') u ORDER BY c LIMIT 10"""
Q["result_diff"] = """SELECT label, sum(e) AS expected, sum(a) AS actual FROM (
  SELECT l.obj AS label, 1 AS e, 0 AS a FROM triples t JOIN triples l ON l.sub = t.sub AND l.pred = 'rdfs:label'
  WHERE t.pred = 'rdf:type' AND t.obj = 'type/PROMO' AND t.kind = 'iri'
  UNION ALL
  SELECT l.obj, 0, 1 FROM triples f JOIN triples l ON l.sub = f.sub AND l.pred = 'rdfs:label'
  WHERE f.pred = 'shop:productFeature' AND f.obj = 'feature/cold' AND f.kind = 'iri') u
GROUP BY label HAVING sum(e) <> sum(a)"""
Q["order_by"] = f"SELECT p, label FROM ({_LABELS}) x ORDER BY label ASC, p DESC"
Q["order_expr"] = """SELECT sub AS offer, obj AS price FROM triples WHERE pred = 'shop:price'
ORDER BY CAST(obj AS DOUBLE) DESC, offer LIMIT 10"""
Q["limit"] = f"SELECT p, label FROM ({_LABELS}) x ORDER BY label, p LIMIT 10"
Q["offset_limit"] = f"SELECT p, label FROM ({_LABELS}) x ORDER BY label, p LIMIT 10 OFFSET 20"
Q["topk_sub"] = """SELECT t.vendor, t.n, l.obj AS name FROM (
  SELECT obj AS vendor, count(sub) AS n FROM triples WHERE pred = 'shop:vendor' GROUP BY obj
  ORDER BY n DESC, vendor LIMIT 5) t JOIN triples l ON l.sub = t.vendor AND l.pred = 'rdfs:label'"""

# ---------------------------------------------------------------- paths and hierarchies
Q["path_seq"] = f"""SELECT a.sub AS review, c.obj AS country FROM triples a {_j("c", "a.obj", "shop:country")}
WHERE a.pred = 'rev:reviewer'"""
Q["path_alt"] = "SELECT sub AS x, obj AS name FROM triples WHERE pred IN ('rdfs:label', 'foaf:name')"
Q["path_inv"] = "SELECT obj AS product, sub AS offer FROM triples WHERE pred = 'shop:product'"
Q["path_mix"] = f"""SELECT a.obj AS product, r.obj AS person FROM triples a {_j("r", "a.sub", "rev:reviewer")}
WHERE a.pred = 'shop:reviewFor'"""
_TC = """WITH RECURSIVE anc(child, ancestor) AS (
  SELECT sub, obj FROM triples WHERE pred = 'rdfs:subClassOf'
  UNION
  SELECT a.child, e.obj FROM anc a JOIN triples e ON e.sub = a.ancestor AND e.pred = 'rdfs:subClassOf'),
direct AS (
  SELECT t.sub AS product, t.obj AS type FROM triples t
  JOIN triples k ON k.sub = t.obj AND k.pred = 'rdf:type' AND k.obj = 'shop:ProductType' AND k.kind = 'iri'
  WHERE t.pred = 'rdf:type'),
tc AS (SELECT product, type FROM direct
       UNION SELECT d.product, a.ancestor FROM direct d JOIN anc a ON a.child = d.type)"""
Q["type_closure"] = _TC + "\nSELECT product, type FROM tc"
Q["type_features"] = _TC + """
SELECT DISTINCT tc.type, f.obj AS feature FROM tc JOIN triples f ON f.sub = tc.product AND f.pred = 'shop:productFeature'"""
Q["type_levels"] = """WITH RECURSIVE e AS (
  SELECT sub AS child, obj AS parent FROM triples WHERE pred IN ('rdfs:subClassOf', 'shop:locatedIn')),
nodes AS (SELECT child AS node FROM e UNION SELECT parent FROM e WHERE parent IS NOT NULL),
roots AS (SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM e WHERE parent IS NOT NULL)),
lv(node, depth) AS (
  SELECT node, 0 FROM roots
  UNION
  SELECT e.child, lv.depth + 1 FROM lv JOIN e ON e.parent = lv.node)
SELECT node, max(depth) AS depth FROM lv GROUP BY node"""

# ---------------------------------------------------------------- query forms
Q["describe"] = """SELECT sub, pred, obj FROM triples WHERE sub IN (
  SELECT sub FROM triples WHERE pred = 'rdf:type' AND obj = 'type/PROMO' AND kind = 'iri')"""
Q["construct"] = f"""SELECT DISTINCT sub, pred, obj, 'iri' AS kind, CAST(NULL AS VARCHAR) AS dt, CAST(NULL AS VARCHAR) AS lang FROM (
  SELECT a.sub AS sub, 'export:vendorCountry' AS pred, c.obj AS obj FROM triples a {_j("c", "a.obj", "shop:country")}
  WHERE a.pred = 'shop:vendor'
  UNION ALL
  SELECT c.obj, 'export:hasOffer', a.sub FROM triples a {_j("c", "a.obj", "shop:country")}
  WHERE a.pred = 'shop:vendor') x"""

# ---------------------------------------------------------------- terms
Q["lang_matches"] = """SELECT coalesce(lang, '') AS lang,
  count(*) FILTER (WHERE lower(coalesce(lang, '')) = 'en' OR lower(coalesce(lang, '')) LIKE 'en-%') AS en,
  count(*) FILTER (WHERE coalesce(lang, '') <> '') AS "any"
FROM triples WHERE pred = 'rev:text' GROUP BY coalesce(lang, '')"""
Q["fn_str"] = f"""SELECT a.sub AS p, a.obj || ' ' || l.obj AS s FROM triples a {_j("l", "a.obj", "rdfs:label")}
WHERE a.pred = 'shop:producer'"""
Q["fn_cast"] = f"""SELECT a.sub AS offer, TRY_CAST(a.obj AS DECIMAL(18,2)) AS priceDec, TRY_CAST(d.obj AS BIGINT) AS ddInt,
  TRY_CAST(a.sub AS BIGINT) AS bad
FROM triples a {_j("d", "a.sub", "shop:deliveryDays")} WHERE a.pred = 'shop:price'"""
_NS = [
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    ("xsd", "http://www.w3.org/2001/XMLSchema#"),
    ("dc", "http://purl.org/dc/elements/1.1/"),
    ("foaf", "http://xmlns.com/foaf/0.1/"),
    ("rev", "http://purl.org/stuff/rev#"),
    ("shop", "http://example.org/shop/vocabulary/"),
    ("inst", "http://example.org/shop/instances/"),
]
_EXPAND = (
    "CASE "
    + " ".join(f"WHEN starts_with(p, '{k}:') THEN '{v}' || substr(p, {len(k) + 2})" for k, v in _NS)
    + " WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN p ELSE 'http://example.org/shop/instances/' || p END"
)
Q["iri_prefix"] = f'SELECT p, full_iri AS "full", p AS short FROM (SELECT DISTINCT pred AS p, {_EXPAND} AS full_iri FROM triples) x'
Q["iri_clean"] = (
    f"SELECT p, regexp_replace(full_iri, '[^A-Za-z0-9]+', '_', 'g') AS clean FROM "
    f"(SELECT DISTINCT pred AS p, {_EXPAND} AS full_iri FROM triples) x"
)
Q["fn_arith"] = f"""SELECT a.sub AS offer, d.num * 2 + 1 AS a, d.num - 7 AS b,
  CAST({_CENTS.format(x="a.obj")} AS DOUBLE) / d.num AS c
FROM triples a {_j("d", "a.sub", "shop:deliveryDays")} WHERE a.pred = 'shop:price'"""

SQL = {k: with_common(v) for k, v in Q.items()}
