"""DuckDB oracles of the storage-layer queries."""

from __future__ import annotations

from spogrid.plans.oracle_base import with_common

RED = """idx_s AS (SELECT DISTINCT sub AS v, pred AS p2 FROM triples),
idx_o AS (SELECT DISTINCT obj AS v, pred AS p2 FROM triples WHERE kind = 'iri'),
red AS (
  SELECT 'SS' AS rel, t.pred AS p1, i.p2, t.sub, t.obj FROM triples t JOIN idx_s i ON t.sub = i.v WHERE t.pred <> i.p2
  UNION ALL
  SELECT 'OS', t.pred, i.p2, t.sub, t.obj FROM triples t JOIN idx_s i ON t.obj = i.v WHERE t.kind = 'iri'
  UNION ALL
  SELECT 'SO', t.pred, i.p2, t.sub, t.obj FROM triples t JOIN idx_o i ON t.sub = i.v),
vp AS (SELECT pred AS p1, count(*) AS vp_size FROM triples GROUP BY pred),
stats AS (
  SELECT c.rel, c.p1, c.p2, c.size, vp.vp_size,
         ((c.size * 200 + vp.vp_size) // (vp.vp_size * 2)) / 100 AS ratio,
         CAST(vp.vp_size AS DOUBLE) / (SELECT count(*) FROM triples) AS vp_ratio
  FROM (SELECT rel, p1, p2, count(*) AS size FROM red GROUP BY rel, p1, p2) c JOIN vp USING (p1)),
bstats AS (SELECT *, size < vp_size * 0.25 AS stored FROM stats)"""


def _q(body: str) -> str:
    return with_common(body, RED)


_CHOICE = [
    ("?review", "shop:reviewFor", "?product"),
    ("?review", "shop:rating4", "?r4"),
    ("?product", "rdfs:label", "?label"),
    ("?product", "shop:productPropertyTextual4", "?t4"),
]


# Pairs of patterns that share a variable, as (pattern, relation, its predicate, the other's).
_CHOICE_PAIRS = [
    (0, "SS", "shop:reviewFor", "shop:rating4"),
    (0, "OS", "shop:reviewFor", "rdfs:label"),
    (0, "OS", "shop:reviewFor", "shop:productPropertyTextual4"),
    (1, "SS", "shop:rating4", "shop:reviewFor"),
    (2, "SO", "rdfs:label", "shop:reviewFor"),
    (2, "SS", "rdfs:label", "shop:productPropertyTextual4"),
    (3, "SO", "shop:productPropertyTextual4", "shop:reviewFor"),
    (3, "SS", "shop:productPropertyTextual4", "rdfs:label"),
]
_EMPTY_PAIRS = [(0, "SS", "shop:price", "foaf:name"), (1, "SS", "foaf:name", "shop:price")]


def _values(rows):
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


_C = _CHOICE_PAIRS
CHOOSE = f"""
WITH cand(cand, idx, rel, p1, p2) AS (VALUES {_values([(k,) + c for k, c in enumerate(_C)])}),
scored AS (
  SELECT c.idx, c.cand, c.rel, c.p1, c.p2, s.size FROM cand c JOIN bstats s USING (rel, p1, p2) WHERE s.stored
  UNION ALL
  SELECT v.idx, -1, 'VP', v.p1, CAST(NULL AS VARCHAR), vp.vp_size
  FROM (VALUES {_values([(i, p) for i, (_, p, _) in enumerate(_CHOICE)])}) v(idx, p1) LEFT JOIN vp USING (p1))
SELECT idx, rel, p1, p2, size FROM (
  SELECT *, row_number() OVER (PARTITION BY idx ORDER BY size, cand) AS rn FROM scored) WHERE rn = 1
"""

_E = _EMPTY_PAIRS
EMPTY = f"""
SELECT c.idx, c.rel, c.p1, c.p2 FROM (VALUES {_values(_E)}) c(idx, rel, p1, p2)
WHERE NOT EXISTS (SELECT 1 FROM stats s WHERE s.rel = c.rel AND s.p1 = c.p1 AND s.p2 = c.p2)
"""

BGP_EXTVP = """
SELECT rf.sub AS review, rf.obj AS product, r4.obj AS r4, l.obj AS label, t4.obj AS t4
FROM triples rf
JOIN triples r4 ON r4.sub = rf.sub AND r4.pred = 'shop:rating4'
JOIN triples l ON l.sub = rf.obj AND l.pred = 'rdfs:label'
JOIN triples t4 ON t4.sub = rf.obj AND t4.pred = 'shop:productPropertyTextual4'
WHERE rf.pred = 'shop:reviewFor'
"""

SQL = {
    "tt_count": with_common("SELECT kind, count(*) AS n FROM triples GROUP BY kind"),
    "predicates": with_common("SELECT DISTINCT pred FROM triples"),
    "vp_sizes": with_common("SELECT pred, count(*) AS size FROM triples GROUP BY pred"),
    "related_predicates": _q("SELECT DISTINCT p1, p2 FROM red WHERE rel = 'SS'"),
    "extvp_ss": _q("SELECT p1, p2, count(*) AS size FROM red WHERE rel = 'SS' GROUP BY p1, p2"),
    "extvp_os": _q("SELECT p1, p2, count(*) AS size FROM red WHERE rel = 'OS' GROUP BY p1, p2"),
    "extvp_so": _q("SELECT p1, p2, count(*) AS size FROM red WHERE rel = 'SO' GROUP BY p1, p2"),
    "extvp_stats": _q("SELECT * FROM stats"),
    "extvp_bounded": _q("SELECT rel, p1, p2, size, stored FROM bstats"),
    "extvp_summary": _q(
        """SELECT r.rel, count(*) FILTER (WHERE stored) AS saved, count(*) FILTER (WHERE NOT stored) AS unsaved_nonempty,
       CASE WHEN r.rel = 'SS' THEN n * (n - 1) ELSE n * n END - count(stored) AS empty
FROM (VALUES ('SS'), ('OS'), ('SO')) r(rel) CROSS JOIN (SELECT count(DISTINCT pred) AS n FROM triples) np
LEFT JOIN bstats b ON b.rel = r.rel GROUP BY r.rel, n"""
    ),
    "extvp_storage": _q(
        "SELECT rel, sum(size) AS stored_triples, count(*) AS tables FROM bstats WHERE stored GROUP BY rel"
    ),
    "extvp_rows": _q(
        """SELECT rel, p1, p2, count(*) AS size, count(DISTINCT sub) AS n_sub, min(obj) AS min_obj, max(obj) AS max_obj
FROM red JOIN (SELECT rel, p1, p2 FROM bstats WHERE stored) k USING (rel, p1, p2) GROUP BY rel, p1, p2"""
    ),
    "choose_tables": _q(CHOOSE.replace("WITH cand", "WITH cand", 1)),
    "empty_relation": _q(EMPTY),
    "bgp_extvp": with_common(BGP_EXTVP),
    "bgp_sketched": with_common(BGP_EXTVP),
    "sketch_stats": with_common("SELECT pred, count(*) AS n, true AS subjects_near, true AS objects_near, true AS median_near FROM triples GROUP BY pred"),
    "catalog_layout": with_common(
        """SELECT pred, count(*) AS n, count(*) FILTER (WHERE kind = 'iri') AS n_iri, min(sub) AS min_sub, max(sub) AS max_sub
FROM triples GROUP BY pred"""
    ),
}
