"""DuckDB side of the correctness check: the shop entities and triples in SQL.

These CTEs restate, in plain SQL over the same parquet tables, the entity and
triple definitions of ``spogrid.sources``; every oracle query is
``WITH <these>, <its own CTEs> SELECT ...``.  DuckDB pushes the predicate
filters into the UNION ALL, so unused branches cost little.
"""

from __future__ import annotations

ENTITY_CTES = r"""
product AS (
  SELECT p_partkey AS nr, p_name AS label, concat_ws(' ', p_name, 'by', p_brand) AS comment,
         p_type AS type, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS producer,
         CAST(p_size AS BIGINT) AS propertyNum1, p_partkey % 500 AS propertyNum2,
         (p_partkey * 7) % 500 AS propertyNum3,
         CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) * 10 END AS propertyNum4,
         concat_ws(' ', p_brand, p_name) AS propertyTex1,
         concat_ws(' ', p_type, p_name) AS propertyTex2,
         concat_ws(' ', p_name, 'size', CAST(p_size AS VARCHAR)) AS propertyTex3,
         CASE WHEN p_partkey % 4 = 0 THEN p_name || ' extra' END AS propertyTex4,
         CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' special' END AS propertyTex5
  FROM part),
productfeatureproduct AS (
  SELECT DISTINCT product, productFeature FROM (
    SELECT p_partkey AS product, unnest(string_split(p_name, ' ')) AS productFeature FROM part
    UNION ALL
    SELECT p_partkey, 'size' || CAST(p_size % 10 AS VARCHAR) FROM part) w
  WHERE productFeature <> ''),
productfeature AS (SELECT DISTINCT productFeature AS nr, productFeature AS label FROM productfeatureproduct),
producttypeproduct AS (SELECT p_partkey AS product, p_type AS productType FROM part),
producttype AS (
  SELECT DISTINCT p_type AS nr, p_type AS label, 'Thing' AS parent FROM part
  UNION ALL
  SELECT 'Thing', 'Thing', NULL WHERE EXISTS (SELECT 1 FROM part)),
producer AS (
  SELECT CAST(split_part(label, '#', 2) AS BIGINT) AS nr, label,
         'site/producer' || CAST(CAST(split_part(label, '#', 2) AS BIGINT) AS VARCHAR) AS homepage,
         CAST(CAST(split_part(label, '#', 2) AS BIGINT) % 25 AS INTEGER) AS country
  FROM (SELECT DISTINCT p_brand AS label FROM part) b),
vendor AS (
  SELECT s_suppkey AS nr, s_name AS label, 'site/vendor' || CAST(s_suppkey AS VARCHAR) AS homepage,
         s_nationkey AS country FROM supplier),
person AS (
  SELECT c_custkey AS nr, c_name AS name, sha1('mailto:' || lower(c_name)) AS mbox_sha1sum,
         c_nationkey AS country FROM customer),
country AS (SELECT n_nationkey AS nr, n_name AS label, n_regionkey AS region, n_nationkey * n_nationkey % 25 AS partner FROM nation),
region_e AS (SELECT r_regionkey AS nr, r_name AS label, 'region/' || CAST(r_regionkey AS VARCHAR) AS note FROM region),
offer AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS nr,
         l_partkey AS product, l_suppkey AS vendor,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_shipdate AS validTo,
         CAST(l_linenumber AS BIGINT) AS deliveryDays,
         'site/vendor' || CAST(l_suppkey AS VARCHAR) || '/offer/'
           || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS offerWebpage
  FROM lineitem),
review_core AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS nr,
         l_orderkey AS orderkey, l_partkey AS product,
         'review of product ' || CAST(l_partkey AS VARCHAR) AS title,
         CAST(l_linenumber AS BIGINT) AS rating1,
         CASE WHEN l_tax > 0.04 THEN CAST(floor(l_quantity) AS BIGINT) % 10 + 1 END AS rating2,
         CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_quantity) AS BIGINT) % 7 + 1 END AS rating3,
         CASE WHEN l_quantity > 25 THEN CAST(3 AS BIGINT) END AS rating4
  FROM lineitem WHERE l_returnflag = 'R'),
review_order AS (
  SELECT rc.nr, o_custkey AS person, o_orderdate AS reviewDate
  FROM review_core rc JOIN orders ON o_orderkey = rc.orderkey),
review_text AS (
  SELECT rc.nr, d.text AS text, d.lang AS language
  FROM review_core rc JOIN documents d ON d.doc_id = rc.orderkey % (SELECT count(*) FROM documents)),
review AS (
  SELECT rc.nr, rc.product, rc.title, rc.rating1, rc.rating2, rc.rating3, rc.rating4,
         o_custkey AS person, o_orderdate AS reviewDate, d.text AS text, d.lang AS language
  FROM review_core rc JOIN orders ON o_orderkey = rc.orderkey
  LEFT JOIN documents d ON d.doc_id = rc.orderkey % (SELECT count(*) FROM documents))
"""


def _lit_str(src, sub, pred, col):
    return (
        f"SELECT {sub} AS sub, '{pred}' AS pred, {col} AS obj, 'lit' AS kind, 'xsd:string' AS dt, "
        f"CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS DOUBLE) AS num, CAST(NULL AS TIMESTAMP) AS ts "
        f"FROM {src} WHERE {col} IS NOT NULL"
    )


def _lit_int(src, sub, pred, col):
    return (
        f"SELECT {sub}, '{pred}', CAST({col} AS VARCHAR), 'lit', 'xsd:integer', NULL, "
        f"CAST({col} AS DOUBLE), NULL FROM {src} WHERE {col} IS NOT NULL"
    )


def _iri(src, sub, pred, obj):
    return f"SELECT {sub}, '{pred}', {obj}, 'iri', NULL, NULL, NULL, NULL FROM {src} WHERE ({obj}) IS NOT NULL"


def _type(src, sub, cls):
    return _iri(src, sub, "rdf:type", f"'{cls}'")


def _triples_sql() -> str:
    ps = "'product/' || CAST(nr AS VARCHAR)"
    rv = "'review/' || nr"
    of = "'offer/' || nr"
    parts = [
        _lit_str("product", ps, "rdfs:label", "label"),  # first branch names the columns
        _type("product", ps, "shop:Product"),
        _iri("product", ps, "rdf:type", "'type/' || type"),
        _lit_str("product", ps, "rdfs:comment", "comment"),
        _iri("product", ps, "shop:producer", "'producer/' || CAST(producer AS VARCHAR)"),
        _iri("product", ps, "dc:publisher", "'producer/' || CAST(producer AS VARCHAR)"),
    ]
    parts += [_lit_int("product", ps, f"shop:productPropertyNumeric{i}", f"propertyNum{i}") for i in (1, 2, 3, 4)]
    parts += [_lit_str("product", ps, f"shop:productPropertyTextual{i}", f"propertyTex{i}") for i in (1, 2, 3, 4, 5)]
    parts += [
        _iri(
            "productfeatureproduct",
            "'product/' || CAST(product AS VARCHAR)",
            "shop:productFeature",
            "'feature/' || productFeature",
        ),
        _type("productfeature", "'feature/' || nr", "shop:ProductFeature"),
        _lit_str("productfeature", "'feature/' || nr", "rdfs:label", "label"),
        _type("producttype", "'type/' || nr", "shop:ProductType"),
        _lit_str("producttype", "'type/' || nr", "rdfs:label", "label"),
        _iri("producttype", "'type/' || nr", "rdfs:subClassOf", "'type/' || parent"),
    ]
    for src, prefix, cls in (("producer", "producer/", "shop:Producer"), ("vendor", "vendor/", "shop:Vendor")):
        s = f"'{prefix}' || CAST(nr AS VARCHAR)"
        parts += [
            _type(src, s, cls),
            _lit_str(src, s, "rdfs:label", "label"),
            _iri(src, s, "foaf:homepage", "homepage"),
            _iri(src, s, "shop:country", "'nation/' || CAST(country AS VARCHAR)"),
        ]
    pe = "'person/' || CAST(nr AS VARCHAR)"
    parts += [
        _type("person", pe, "foaf:Person"),
        _lit_str("person", pe, "foaf:name", "name"),
        _lit_str("person", pe, "foaf:mbox_sha1sum", "mbox_sha1sum"),
        _iri("person", pe, "shop:country", "'nation/' || CAST(country AS VARCHAR)"),
    ]
    cs = "'nation/' || CAST(nr AS VARCHAR)"
    rs = "'region/' || CAST(nr AS VARCHAR)"
    parts += [
        _type("country", cs, "shop:Country"),
        _lit_str("country", cs, "rdfs:label", "label"),
        _iri("country", cs, "shop:locatedIn", "'region/' || CAST(region AS VARCHAR)"),
        _iri("country", cs, "shop:partner", "'nation/' || CAST(partner AS VARCHAR)"),
        _lit_str("region_e", rs, "rdfs:comment", "note"),
        _type("region_e", rs, "shop:Region"),
        _lit_str("region_e", rs, "rdfs:label", "label"),
        _iri("region_e", rs, "shop:locatedIn", "'region/World'"),
    ]
    parts += [
        _type("offer", of, "shop:Offer"),
        _iri("offer", of, "shop:product", "'product/' || CAST(product AS VARCHAR)"),
        _iri("offer", of, "shop:vendor", "'vendor/' || CAST(vendor AS VARCHAR)"),
        _iri("offer", of, "dc:publisher", "'vendor/' || CAST(vendor AS VARCHAR)"),
        f"SELECT {of}, 'shop:price', CAST(price AS VARCHAR), 'lit', 'shop:USD', NULL, CAST(price AS DOUBLE), NULL "
        "FROM offer WHERE price IS NOT NULL",
        _lit_int("offer", of, "shop:deliveryDays", "deliveryDays"),
        f"SELECT {of}, 'shop:validTo', strftime(validTo, '%Y-%m-%dT%H:%M:%S'), 'lit', 'xsd:dateTime', NULL, NULL, "
        "validTo FROM offer WHERE validTo IS NOT NULL",
        _iri("offer", of, "shop:offerWebpage", "offerWebpage"),
        _type("review_core", rv, "rev:Review"),
        _iri("review_core", rv, "shop:reviewFor", "'product/' || CAST(product AS VARCHAR)"),
        _lit_str("review_core", rv, "dc:title", "title"),
    ]
    parts += [_lit_int("review_core", rv, f"shop:rating{i}", f"rating{i}") for i in (1, 2, 3, 4)]
    parts += [
        _iri("review_order", rv, "rev:reviewer", "'person/' || CAST(person AS VARCHAR)"),
        _iri("review_order", rv, "dc:publisher", "'person/' || CAST(person AS VARCHAR)"),
        f"SELECT {rv}, 'shop:reviewDate', strftime(reviewDate, '%Y-%m-%dT%H:%M:%S'), 'lit', 'xsd:dateTime', NULL, "
        "NULL, reviewDate FROM review_order WHERE reviewDate IS NOT NULL",
        f"SELECT {rv}, 'dc:date', strftime(CAST(reviewDate AS DATE), '%Y-%m-%d'), 'lit', 'xsd:date', NULL, NULL, "
        "CAST(CAST(reviewDate AS DATE) AS TIMESTAMP) FROM review_order WHERE reviewDate IS NOT NULL",
        f"SELECT {rv}, 'rev:text', text, 'lit', NULL, language, NULL, NULL FROM review_text WHERE text IS NOT NULL",
    ]
    return "triples AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


TRIPLES_CTE = _triples_sql()
COMMON = ENTITY_CTES.strip() + ",\n" + TRIPLES_CTE


def with_common(query: str, ctes: str = "") -> str:
    """``WITH <entities>, triples, <ctes> <query>``; a query that starts with its
    own ``WITH`` has its CTEs appended to the common list."""
    extra = (",\n" + ctes.strip()) if ctes.strip() else ""
    q = query.strip()
    if q[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {COMMON}{extra},\n{q[15:]}"
    if q[:5].upper() == "WITH ":
        return f"WITH {COMMON}{extra},\n{q[5:]}"
    return f"WITH {COMMON}{extra}\n{q}"
