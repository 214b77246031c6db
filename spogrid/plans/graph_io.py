"""Queries over text formats, quads, property tables and graph updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spogrid.functions.terms import format_term, parse_term, shorten, typed_value_columns
from spogrid.operators.aggregates import summary
from spogrid.operators.patterns import bgp
from spogrid.operators.updates import delete_where, describe_where, insert_data, insert_graph
from spogrid.session import materialize, shared_folder
from spogrid.sources import quads as Q
from spogrid.sources import textio
from spogrid.sources.store import as_frame

PRODUCT_COLUMNS = {
    "label": "rdfs:label",
    "num1": "shop:productPropertyNumeric1",
    "num2": "shop:productPropertyNumeric2",
    "num4": "shop:productPropertyNumeric4",
    "tex4": "shop:productPropertyTextual4",
}


def triplify(tr) -> DataFrame:
    """The triple table by predicate: size, distinct subjects, smallest and largest object."""
    aggs = {"n": F.count(F.lit(1)), "min_obj": F.min("obj"), "max_obj": F.max("obj")}
    return summary(as_frame(tr), ["pred"], {"n_sub": "sub"}, aggs).select("pred", "n", "n_sub", "min_obj", "max_obj")


def _read_summary(triples: DataFrame) -> DataFrame:
    """What was read, by predicate and kind of object."""
    aggs = {
        "n": F.count(F.lit(1)), "min_obj": F.min("obj"), "max_obj": F.max("obj"), "n_chars": F.sum(F.length("obj")), "n_lang": F.count("lang"),
        "dt": F.min("dt"), "min_num": F.min("num"), "max_num": F.max("num"), "max_ts": F.max("ts"),
    }
    shown = ["pred", "kind", "n", "n_sub", *[k for k in aggs if k != "n"]]
    triples = materialize(triples, "triples-read")  # parsed once
    return summary(triples, ["pred", "kind"], {"n_sub": "sub"}, aggs).select(*shown)


def ntriples_parse(t) -> DataFrame:
    """Write the whole store as N-Triples files, read the files, summarize the triples read."""
    path = shared_folder(t.spark, "ntriples")
    textio.write_ntriples(t.store, path)
    return _read_summary(textio.read_ntriples(t.spark, path))


def tsv_read(t) -> DataFrame:
    """The same with tab-separated files."""
    path = shared_folder(t.spark, "tsv")
    textio.write_tsv(t.store, path)
    return _read_summary(textio.read_tsv(t.spark, path))


# Bytes above which an object's text is written and read back once for all triples that have it.
LONG = 256


def _read_back(t: DataFrame, value: str, name: str) -> DataFrame:
    """``t`` with ``name``: whether the object term of ``value``, written and read back, is the same."""
    t = t.withColumn("__text", format_term(F.col(value), F.col("kind"), F.col("dt"), F.col("lang")))
    t = t.withColumn("__p", parse_term(F.col("__text")))
    p = F.col("__p")
    # IRIs are written expanded; compare them after shortening back
    read = F.when(p["kind"] == "iri", shorten(p["value"])).otherwise(p["value"])
    same = (read == F.col(value)) & (p["kind"] == F.col("kind")) & p["lang"].eqNullSafe(F.col("lang")) & p["dt"].eqNullSafe(F.col("dt"))
    return t.withColumn(name, same)


def literal_parse(tr) -> DataFrame:
    """Object terms to text and back: lexical form, kind, datatype and language.

    Long texts are grouped before, so that one that many triples have is written and read back once."""
    term = ["kind", "dt", "lang"]
    is_long = F.coalesce(F.octet_length("obj") > LONG, F.lit(False))
    t = as_frame(tr).select(*term, F.when(~is_long, F.col("obj")).alias("short"), F.when(is_long, F.col("obj")).alias("long"))
    t = _read_back(t, "short", "same").groupBy(*term, "long").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("same"), 1)).alias("n_short"))
    t = _read_back(t, "long", "same")
    return t.groupBy(*term).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(F.col("n_short"))).alias("same"))


def typed_objects(tr) -> DataFrame:
    """Retype every literal from its lexical form and datatype."""
    t = as_frame(tr)
    num, ts = typed_value_columns(F.col("obj"), F.col("dt"))
    t = t.select("pred", F.when(F.col("kind") == "lit", num).alias("v"), F.when(F.col("kind") == "lit", ts).alias("t"))
    return t.groupBy("pred").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("v").alias("n_num"),
        F.count("t").alias("n_ts"),
        F.min("v").alias("min_num"),
        F.max("v").alias("max_num"),
        F.min("t").alias("min_ts"),
        F.max("t").alias("max_ts"),
    )


def ntriples_format(tr) -> DataFrame:
    """N-Triples text of every vendor description."""
    vendors = describe_where(tr, [("?v", "rdf:type", "shop:Vendor")], "?v", terms=True)
    return textio.format_ntriples(vendors)


def quads_provenance(tables) -> DataFrame:
    quads = Q.order_graphs(tables, tables.store)
    return Q.provenance(quads)


def property_table(tr) -> DataFrame:
    return Q.property_table(tr, PRODUCT_COLUMNS)


def property_bridge(tr) -> DataFrame:
    """Values of the multi-valued ones among some predicates."""
    return Q.property_tables(tr, PRODUCT_COLUMNS | {"feature": "shop:productFeature", "class": "rdf:type"})[1]


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "pred").agg(F.count(F.lit(1)).alias("n"))


def _iri_triples(df: DataFrame) -> DataFrame:
    return df.select(
        "sub", "pred", "obj", F.lit("iri").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in
        (("dt", "string"), ("lang", "string"), ("num", "double"), ("ts", "timestamp_ntz"))]
    )


def insert_data_q(tr) -> DataFrame:
    """INSERT DATA of inverse review links plus already present labels (set semantics)."""
    inverse = bgp(tr, [("?r", "shop:reviewFor", "?p")]).select(
        F.col("p").alias("sub"), F.lit("shop:hasReview").alias("pred"), F.col("r").alias("obj")
    )
    new = _iri_triples(inverse).unionByName(tr.vp("rdfs:label") if hasattr(tr, "vp") else as_frame(tr))
    return _counts(insert_data(tr, new))


def delete_where_q(tr) -> DataFrame:
    """DELETE WHERE { ?o shop:deliveryDays 7 . ?o ?p ?x }."""
    out = delete_where(tr, [("?o", "shop:deliveryDays", 7), ("?o", "?p", "?x")])
    return _counts(out)


def insert_graph_q(tables) -> DataFrame:
    quads = Q.order_graphs(tables, tables.store)
    flagged = bgp(tables.store, [("?r", "shop:rating4", "?x")]).select(
        F.col("r").alias("sub"), F.lit("shop:flagged").alias("pred"), F.lit("yes").alias("obj")
    )
    new = flagged.select(
        "sub", "pred", "obj", F.lit("lit").alias("kind"), F.lit("xsd:string").alias("dt"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("num"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
    )
    return _counts(insert_graph(quads, new, "graph/1-URGENT"), "graph")


def delete_graph_q(tables) -> DataFrame:
    quads = Q.order_graphs(tables, tables.store)
    out = delete_where(quads, [("?o", "shop:deliveryDays", 1)], graph="graph/5-LOW")
    return _counts(out, "graph")


def sql_views(tr) -> DataFrame:
    """Register the store as SQL views (one per predicate) and query them with
    named parameters: product labels containing a word, with their size."""
    from spogrid.sources.store import register

    spark = as_frame(tr).sparkSession
    register(spark, tr, "shop")
    return spark.sql(
        """SELECT l.sub AS product, l.obj AS label, CAST(n.num AS BIGINT) AS size
           FROM shop_vp_rdfs_label l JOIN shop_vp_shop_productPropertyNumeric1 n ON n.sub = l.sub
           WHERE l.obj LIKE :pattern AND n.num >= :min_size""",
        args={"pattern": "%gear%", "min_size": 10},
    )
