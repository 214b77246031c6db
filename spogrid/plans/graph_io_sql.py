"""DuckDB oracles of text-format, quad, property-table, update and run-log queries."""

from __future__ import annotations

from spogrid.plans.oracle_base import with_common
from spogrid.plans.units_sql import _NS

Q: dict[str, str] = {}


def _expand(x: str) -> str:
    return (
        "CASE "
        + " ".join(f"WHEN starts_with({x}, '{k}:') THEN '{v}' || substr({x}, {len(k) + 2})" for k, v in _NS)
        + f" WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {x} ELSE 'http://example.org/shop/instances/' || {x} END"
    )


_ESC = "replace(replace(replace(replace(replace(obj, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_OBJ = (
    f"CASE WHEN kind = 'iri' THEN '<' || {_expand('obj')} || '>' "
    f"ELSE '\"' || {_ESC} || '\"' || CASE WHEN lang IS NOT NULL THEN '@' || lang "
    f"WHEN dt IS NOT NULL AND dt <> 'xsd:string' THEN '^^<' || {_expand('dt')} || '>' ELSE '' END END"
)
_LINE = f"'<' || {_expand('sub')} || '> <' || {_expand('pred')} || '> ' || {_OBJ} || ' .'"

Q["triplify"] = """SELECT pred, count(*) AS n, count(DISTINCT sub) AS n_sub, min(obj) AS min_obj, max(obj) AS max_obj
FROM triples GROUP BY pred"""
Q["ntriples_parse"] = """SELECT pred, kind, count(*) AS n, count(DISTINCT sub) AS n_sub, min(obj) AS min_obj, max(obj) AS max_obj,
  sum(length(obj)) AS n_chars, count(lang) AS n_lang, min(dt) AS dt, min(num) AS min_num, max(num) AS max_num, max(ts) AS max_ts
FROM triples GROUP BY pred, kind"""
Q["tsv_read"] = Q["ntriples_parse"]
Q["literal_parse"] = "SELECT kind, dt, lang, count(*) AS n, count(*) AS same FROM triples GROUP BY kind, dt, lang"
Q["typed_objects"] = """SELECT pred, count(*) AS n, count(num) AS n_num, count(ts) AS n_ts, min(num) AS min_num,
  max(num) AS max_num, min(ts) AS min_ts, max(ts) AS max_ts FROM triples GROUP BY pred"""
Q["ntriples_format"] = f"""SELECT {_LINE} AS line FROM triples
WHERE sub IN (SELECT sub FROM triples WHERE pred = 'rdf:type' AND obj = 'shop:Vendor' AND kind = 'iri')"""

_QUADS = """quads AS (
  SELECT t.*, 'graph/' || o.o_orderpriority AS graph FROM triples t
  LEFT JOIN orders o ON o.o_orderkey = TRY_CAST(split_part(split_part(t.sub, '/', 2), '-', 1) AS BIGINT)
  WHERE t.sub LIKE 'offer/%' OR t.sub LIKE 'review/%'
  UNION ALL
  SELECT t.*, 'graph/default' FROM triples t WHERE NOT (t.sub LIKE 'offer/%' OR t.sub LIKE 'review/%'))"""
Q["quads_provenance"] = (
    "WITH " + _QUADS + """,
g AS (SELECT graph, count(*) AS n, max(ts) AS latest FROM quads GROUP BY graph)
SELECT graph AS sub, 'dc:publisher' AS pred, 'site/publisher' AS obj FROM g
UNION ALL SELECT graph, 'dc:date', strftime(latest, '%Y-%m-%dT%H:%M:%S') FROM g WHERE latest IS NOT NULL
UNION ALL SELECT graph, 'shop:size', CAST(n AS VARCHAR) FROM g"""
)
Q["property_table"] = """SELECT sub,
  min(obj) FILTER (WHERE pred = 'rdfs:label') AS label,
  min(obj) FILTER (WHERE pred = 'shop:productPropertyNumeric1') AS num1,
  min(obj) FILTER (WHERE pred = 'shop:productPropertyNumeric2') AS num2,
  min(obj) FILTER (WHERE pred = 'shop:productPropertyNumeric4') AS num4,
  min(obj) FILTER (WHERE pred = 'shop:productPropertyTextual4') AS tex4
FROM triples WHERE pred IN ('rdfs:label', 'shop:productPropertyNumeric1', 'shop:productPropertyNumeric2',
  'shop:productPropertyNumeric4', 'shop:productPropertyTextual4') GROUP BY sub"""
Q["property_bridge"] = """SELECT sub, CASE pred WHEN 'rdf:type' THEN 'class' ELSE 'feature' END AS property, obj AS value
FROM triples WHERE pred IN ('rdf:type', 'shop:productFeature')"""
Q["insert_data"] = """WITH new AS (
  SELECT obj AS sub, 'shop:hasReview' AS pred, sub AS obj FROM triples WHERE pred = 'shop:reviewFor'
  UNION ALL SELECT sub, pred, obj FROM triples WHERE pred = 'rdfs:label'),
fresh AS (SELECT DISTINCT sub, pred, obj FROM new EXCEPT SELECT sub, pred, obj FROM triples)
SELECT pred, count(*) AS n FROM (SELECT pred FROM triples UNION ALL SELECT pred FROM fresh) u GROUP BY pred"""
Q["delete_where"] = """WITH o AS (SELECT sub FROM triples WHERE pred = 'shop:deliveryDays' AND num = 7 AND kind = 'lit'),
gone AS (SELECT DISTINCT t.sub, t.pred, t.obj FROM triples t JOIN o ON t.sub = o.sub)
SELECT pred, count(*) AS n FROM triples t
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.sub = t.sub AND g.pred = t.pred AND g.obj = t.obj)
GROUP BY pred"""
Q["insert_graph"] = (
    "WITH " + _QUADS + """,
new AS (SELECT DISTINCT 'graph/1-URGENT' AS graph, sub, 'shop:flagged' AS pred, 'yes' AS obj
        FROM triples WHERE pred = 'shop:rating4'),
fresh AS (SELECT graph, sub, pred, obj FROM new EXCEPT SELECT graph, sub, pred, obj FROM quads)
SELECT graph, pred, count(*) AS n FROM (SELECT graph, pred FROM quads UNION ALL SELECT graph, pred FROM fresh) u
GROUP BY graph, pred"""
)
Q["delete_graph"] = (
    "WITH " + _QUADS + """,
gone AS (SELECT graph, sub, pred, obj FROM quads
         WHERE graph = 'graph/5-LOW' AND pred = 'shop:deliveryDays' AND num = 1 AND kind = 'lit')
SELECT graph, pred, count(*) AS n FROM quads q
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.graph = q.graph AND g.sub = q.sub AND g.pred = q.pred AND g.obj = q.obj)
GROUP BY graph, pred"""
)

Q["stream_updates"] = """WITH ins AS (
  SELECT obj AS sub, 'shop:hasReview' AS pred, sub AS obj FROM triples WHERE pred = 'shop:reviewFor'),
del7 AS (SELECT t.sub, t.pred, t.obj FROM triples t
         WHERE t.sub IN (SELECT sub FROM triples WHERE pred = 'shop:deliveryDays' AND num = 7 AND kind = 'lit')),
del4 AS (SELECT rf.obj AS sub, 'shop:hasReview' AS pred, rf.sub AS obj FROM triples rf
         JOIN triples r4 ON r4.sub = rf.sub AND r4.pred = 'shop:rating4' WHERE rf.pred = 'shop:reviewFor')
SELECT pred, count(*) AS n FROM (
  SELECT pred FROM triples t
  WHERE NOT EXISTS (SELECT 1 FROM del7 d WHERE d.sub = t.sub AND d.pred = t.pred AND d.obj = t.obj)
  UNION ALL
  SELECT pred FROM (SELECT sub, pred, obj FROM ins EXCEPT SELECT sub, pred, obj FROM del4
                    EXCEPT SELECT sub, pred, obj FROM triples) x) u
GROUP BY pred"""

Q["sql_views"] = """SELECT l.sub AS product, l.obj AS label, CAST(n.num AS BIGINT) AS size
FROM triples l JOIN triples n ON n.sub = l.sub AND n.pred = 'shop:productPropertyNumeric1'
WHERE l.pred = 'rdfs:label' AND l.obj LIKE '%gear%' AND n.num >= 10"""

_LOG = """log AS (SELECT event_type AS query, CAST(ts AS DATE) AS run, value AS seconds, user_id AS n_results,
  event_type = 'error' AS timeout FROM events)"""
R: dict[str, str] = {}
R["run_metrics"] = """SELECT query, count(*) AS runs, round(avg(seconds), 6) AS mean,
  round(exp(avg(ln(seconds))), 6) AS geomean, min(seconds) AS min, max(seconds) AS max,
  round(avg(n_results), 6) AS avg_results, min(n_results) AS min_results, max(n_results) AS max_results,
  count(*) FILTER (WHERE timeout) AS timeouts, round(1 / avg(seconds), 6) AS qps FROM log GROUP BY query"""
R["mix_metrics"] = """SELECT count(*) AS mixes, round(avg(total), 6) AS mean, round(min(total), 6) AS min,
  round(max(total), 6) AS max, round(exp(avg(ln(total))), 6) AS geomean,
  round(3600 / (sum(total) / count(*)), 6) AS mixes_per_hour
FROM (SELECT run, sum(seconds) AS total FROM log GROUP BY run) p"""
R["merge_metrics"] = """SELECT query, sum(n) AS runs, round(sum(s) / sum(n), 6) AS mean, min(lo) AS min, max(hi) AS max,
  round(exp(sum(sl) / sum(n)), 6) AS geomean
FROM (SELECT query, run, count(*) AS n, sum(seconds) AS s, min(seconds) AS lo, max(seconds) AS hi,
        sum(ln(seconds)) AS sl FROM log GROUP BY query, run) p GROUP BY query"""
R["steady_state"] = """SELECT query, run,
  round((max(m) OVER w - min(m) OVER w) / avg(m) OVER w, 6) AS spread,
  (count(m) OVER w = 5) AND ((max(m) OVER w - min(m) OVER w) / avg(m) OVER w < 0.5)
    AND (m >= min(m) OVER (PARTITION BY query ORDER BY run ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS steady
FROM (SELECT query, run, avg(seconds) AS m FROM log GROUP BY query, run) p
WINDOW w AS (PARTITION BY query ORDER BY run ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
R["metrics_pivot"] = "SELECT weekofyear(run) AS week, " + ", ".join(
    f"round(avg(seconds) FILTER (WHERE query = '{q}'), 6) AS {q}" for q in ["click", "error", "purchase", "signup", "view"]
) + " FROM log GROUP BY weekofyear(run)"
R["window_28d"] = """SELECT query, CAST(floor(date_diff('day', DATE '2024-01-01', run) / 28) AS BIGINT) AS "window",
  count(*) AS n FROM log GROUP BY 1, 2"""
_MIX = [1, 2, 2, 3, 2, 2, 4, 2, 2, 5, 7, 7, 5, 7, 7, 8, 9, 9, 8, 9, 9, 10, 10, 11, 12]
R["mix_lookup"] = (
    "SELECT m.query, count(*) AS n FROM (SELECT CAST(event_id % 25 AS INTEGER) AS position FROM events) e "
    "JOIN (VALUES " + ", ".join(f"({i}, {q})" for i, q in enumerate(_MIX)) + ") m(position, query) "
    "ON e.position = m.position GROUP BY m.query"
)

SQL = {k: with_common(v) for k, v in Q.items()}
SQL.update({k: with_common(v, _LOG) for k, v in R.items()})
