"""Named graphs (quads), graph provenance, and property tables.

A quad DataFrame is the triple table plus a ``graph`` column.  Provenance
describes each graph with triples about the graph itself; a property table
turns one predicate per column (``groupBy(sub).pivot(pred)``), multi-valued ones a bridge table.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spogrid.functions.terms import DATETIME_FMT, TRIPLE_COLUMNS
from spogrid.sources.store import TripleStore, as_frame, compatible, explode_branches, select_preds, with_mask

DEFAULT_GRAPH = "graph/default"
PUBLISHER = "site/publisher"
# What the IRIs of offers and reviews begin with.
LINE_PREFIXES = ("offer/", "review/")


def with_graph(triples, graph: Column) -> DataFrame:
    """Quads: every triple with the graph given by ``graph`` (default graph when NULL)."""
    t = as_frame(triples)
    return t.select(*TRIPLE_COLUMNS, F.coalesce(graph, F.lit(DEFAULT_GRAPH)).alias("graph"))


def order_graphs(tables, triples) -> DataFrame:
    """Shop quads: offers and reviews live in the graph of their order's priority."""
    if not (isinstance(triples, TripleStore) and triples.virtual):
        return _line_graphs(tables, as_frame(triples), F.col("sub"))
    frames = []
    for group in triples.sources():
        if len({str(b.sub) for b in group}) > 1 or not triples.is_set(group):
            frames.append(_line_graphs(tables, triples.frame_of(group), F.col("sub")))
            continue
        # a row meets its order once, not each of its triples
        sub = group[0].sub_key
        if sub is not None and not any(compatible(sub.prefix, p) for p in LINE_PREFIXES):
            frames.append(with_graph(triples.frame_of(group).where("sub IS NOT NULL"), F.lit(None).cast("string")))
            continue
        # the mask is made before the join, so that a row moves with no more than is asked for
        placed = _line_rows(tables, with_mask(group[0].source, group), group[0].sub)
        frames += [with_graph(explode_branches(rows, group, ["__graph"]), F.col("__graph")) for rows in placed]
    return reduce(DataFrame.unionByName, frames)


def _line_rows(tables, rows: DataFrame, sub: Column) -> list[DataFrame]:
    """Rows with ``__graph``, the graph of the subject's order (null: none), those of line items and the others."""
    key = F.split_part(F.split_part(sub, F.lit("/"), F.lit(2)), F.lit("-"), F.lit(1)).try_cast("bigint")
    is_line = reduce(lambda x, y: x | y, [sub.startswith(p) for p in LINE_PREFIXES])
    # only line-item subjects join the orders; the rest never enter the shuffle
    # (a NULL join key would pile up in one partition)
    lines = rows.where(is_line).withColumn("__ok", key)
    o = tables.orders.select(F.col("o_orderkey").alias("__ok"), F.concat(F.lit("graph/"), F.col("o_orderpriority")).alias("__graph"))
    return [lines.join(o, "__ok", "left").drop("__ok"), rows.where(~is_line).withColumn("__graph", F.lit(None).cast("string"))]


def _line_graphs(tables, t: DataFrame, sub: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, [with_graph(rows, F.col("__graph")) for rows in _line_rows(tables, t, sub)])


def provenance(quads: DataFrame) -> DataFrame:
    """Triples about each graph: publisher, date (latest temporal value in it) and size."""
    g = quads.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
    rows = F.array(
        F.struct(F.lit("dc:publisher").alias("pred"), F.lit(PUBLISHER).alias("obj")),
        F.struct(F.lit("dc:date").alias("pred"), F.date_format("latest", DATETIME_FMT).alias("obj")),
        F.struct(F.lit("shop:size").alias("pred"), F.col("n").cast("string").alias("obj")),
    )
    out = g.select(F.col("graph").alias("sub"), F.explode(rows).alias("t")).select("sub", "t.pred", "t.obj")
    return out.where(F.col("obj").isNotNull())


def property_tables(triples, columns: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """One row per subject with one column per predicate (``{name: pred}``), and a
    bridge table ``(sub, property, value)``: a predicate of which some subject has several
    values is not a column but has all its values there."""
    names = {p: n for n, p in columns.items()}
    t = select_preds(triples, list(names)).select("sub", "pred", "obj")
    # whether a predicate is multi-valued: one flag for each, decided from counts
    counts = t.groupBy("sub", "pred").agg(F.count(F.lit(1)).alias("n"))
    several = {r["pred"] for r in counts.where("n > 1").select("pred").distinct().collect()}
    single = [p for p in names if p not in several]
    wide = t.where(F.col("pred").isin(single)).groupBy("sub").pivot("pred", single).agg(F.min("obj")) if single else None
    name = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    bridge = t.where(F.col("pred").isin(sorted(several))).select("sub", name[F.col("pred")].alias("property"), F.col("obj").alias("value"))
    if wide is None:
        return t.select("sub").distinct(), bridge
    return wide.select("sub", *[F.col(f"`{p}`").alias(names[p]) for p in single]), bridge


def property_table(triples, columns: Mapping[str, str]) -> DataFrame:
    """The wide table of :func:`property_tables`."""
    return property_tables(triples, columns)[0]
