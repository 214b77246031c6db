from pyspark.sql import functions as F

from spogrid.sources import quads as Q
from spogrid.sources.store import TripleStore, register
from tests.conftest import rows


def test_property_table(graph):
    out = Q.property_table(graph, {"label": "rdfs:label", "num": "shop:num"})
    got = {r.sub: (r.label, r.num) for r in out.collect()}
    assert got["product/1"] == ("red gear", "7")
    assert got["producer/1"] == ("Acme", None)


def test_quads_and_provenance(graph):
    quads = Q.with_graph(graph, F.when(F.col("sub").startswith("product/"), F.lit("graph/p")))
    assert rows(quads.groupBy("graph").count(), "graph", "count") == [("graph/default", 7), ("graph/p", 10)]
    prov = {(r.sub, r.pred): r.obj for r in Q.provenance(quads).collect()}
    assert prov[("graph/p", "shop:size")] == "10"
    assert prov[("graph/default", "dc:publisher")] == Q.PUBLISHER


def test_register_views_and_named_parameters(spark, graph):
    register(spark, TripleStore.from_table(graph), "tiny")
    out = spark.sql(
        "SELECT sub FROM tiny_vp_shop_num WHERE num > :x", args={"x": 5}
    )
    assert rows(out, "sub") == [("product/1",)]
    assert spark.sql("SELECT count(*) FROM tiny").first()[0] == graph.count()


def test_stored_layout_round_trip(spark, graph, tmp_path):
    from spogrid.sources.store import load_triples, write_triples

    write_triples(graph, str(tmp_path / "vp"))
    store = load_triples(spark, str(tmp_path / "vp"))
    assert rows(store.vp("shop:num"), "sub", "obj") == [("product/1", "7"), ("product/2", "3")]
    assert store.all.count() == graph.count()


def test_ntriples_lines(spark):
    from spogrid.sources import textio

    lines = {
        "<a:x> <b:p> <c:y>.": ("a:x", "c:y", "iri", None),
        '<a:x> <b:p> "q\\"uo\\\\"@en . # say "hi"': ("a:x", 'q"uo\\', "lit", "en"),
        '_:b1 <b:p> "\\u00e9\\U0001F600 \\\\u0041 \\b\\f\\n\\t" .': ("_:b1", "é😀 \\u0041 \b\f\n\t", "lit", None),
        "<a:x><b:p>_:z.": ("a:x", "_:z", "bnode", None),
        '<a:x> <b:p> "" .': ("a:x", "", "lit", None),
    }
    wrong = ["garbage", '<a:x> <b:p> "open .', '<a:x> <b:p> "x" <g:h> .']
    df = spark.createDataFrame([(x,) for x in [*lines, *wrong, "# comment", "  "]], "line string")
    got = textio.parse_ntriples(df).collect()
    assert sorted((r["sub"], r["obj"], r["kind"], r["lang"] or "") for r in got) == sorted((s, o, k, g or "") for s, o, k, g in lines.values())
    assert sorted(r["line"] for r in textio.malformed(df).collect()) == sorted(wrong)


def test_bridge_holds_all_values(spark, graph):
    wide, bridge = Q.property_tables(graph.union(graph.where("obj = 'Acme'").replace("Acme", "Ace", "obj")), {"label": "rdfs:label", "num": "shop:num"})
    assert wide.columns == ["sub", "num"]
    assert ("producer/1", "label", "Ace") in rows(bridge, "sub", "property", "value") and bridge.count() == 4


def test_views_must_not_collide(spark, graph):
    import pytest

    two = graph.limit(1).replace("rdf:type", "a-b", "pred").union(graph.limit(1).replace("rdf:type", "a_b", "pred"))
    with pytest.raises(ValueError, match="a_b"):
        register(spark, TripleStore.from_table(two), "clash")


def test_positions_and_intervals(spark):
    from spogrid.operators.algebra import interval_lookup
    from spogrid.operators.metrics import positions

    df = spark.range(500).selectExpr("(id * 37) % 500 AS x").repartition(7).orderBy("x")
    assert rows(positions(df), "x", "pos") == [(k, k) for k in range(500)]
    sizes = [3, 0, 2, 5, 1, 0, 0, 7]
    bounds = spark.createDataFrame(list(enumerate(sizes)), "owner int, n long")
    ids = spark.createDataFrame([(k,) for k in [*range(25), None]], "id long")
    got = {r["id"]: r["owner"] for r in interval_lookup(ids, bounds, "owner", "n").collect()}
    total = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    assert got == {None: None} | {k: next((o for o, t in enumerate(total) if t >= k), None) for k in range(25)}
    plan = interval_lookup(ids, bounds, "owner", "n")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    import pytest

    from spogrid import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
