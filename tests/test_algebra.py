from pyspark.sql import functions as F

from spogrid.functions.terms import num
from spogrid.operators import algebra as G
from spogrid.operators.patterns import bgp
from tests.conftest import rows


def test_optional_keeps_unmatched_rows(graph):
    base = bgp(graph, [("?p", "rdf:type", "shop:Product")])
    out = G.optional(base, bgp(graph, [("?r", "shop:reviewFor", "?p")]))
    assert rows(out, "p", "r") == [("product/1", "review/1"), ("product/2", None)]


def test_optional_filter_is_part_of_the_join(graph):
    base = bgp(graph, [("?p", "rdf:type", "shop:Product")])
    out = G.optional(base, bgp(graph, [("?p", "shop:num", "?n")]), cond=num("n") > 5)
    assert rows(out, "p", "n") == [("product/1", "7"), ("product/2", None)]


def test_optional_without_shared_variable_keeps_left(graph):
    base = bgp(graph, [("?p", "rdf:type", "shop:Product")])
    other = bgp(graph, [("?q", "rdfs:label", "?l")]).where(F.col("l") == "Acme")
    out = G.optional(base, other, cond=F.col("p") == "product/1")
    assert rows(out, "p", "q") == [("product/1", "producer/1"), ("product/2", None)]


def test_not_exists_and_bound(graph):
    base = bgp(graph, [("?p", "rdf:type", "shop:Product")])
    revs = bgp(graph, [("?r", "shop:reviewFor", "?p")])
    assert rows(G.not_exists(base, revs), "p") == [("product/2",)]
    assert rows(G.exists(base, revs), "p") == [("product/1",)]
    opt = G.optional(base, revs).where(F.col("r").isNull())
    assert rows(opt, "p") == [("product/2",)]


def test_union_pads_missing_variables(graph):
    a = bgp(graph, [("?p", "rdfs:label", "?l")]).select("p", "l")
    b = bgp(graph, [("?p", "shop:num", "?n")]).select("p", "n")
    out = G.union(a, b)
    assert set(out.columns) == {"p", "l", "n"}
    assert out.count() == 5


def test_join_with_unbound_variable_is_compatible(spark):
    a = spark.createDataFrame([("x", None), ("y", "1")], "k string, v string")
    b = spark.createDataFrame([("x", "5"), ("y", "2")], "k string, v string")
    out = G.join(a, b, maybe_unbound=["v"])
    assert rows(out, "k", "v") == [("x", "5")]


def test_slice_limit_zero_and_offset_after_distinct(spark):
    df = spark.createDataFrame([(i % 5,) for i in range(20)], "x int")
    assert G.slice_(df, order=["x"], limit=0).count() == 0
    out = G.slice_(df, project=["x"], distinct=True, order=["x"], offset=2, limit=2)
    assert [r.x for r in out.collect()] == [2, 3]


def test_limit_applies_to_the_union(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(3,), (4,)], "x int")
    out = G.slice_(G.union(a, b), order=["x"], offset=1, limit=2)
    assert [r.x for r in out.collect()] == [2, 3]


def test_band_join(spark):
    a = spark.createDataFrame([("f", 10.0, "a1"), ("f", 30.0, "a2"), ("g", 10.0, "a3")], "k string, x double, a string")
    b = spark.createDataFrame([("f", 12.0)], "k string, y double")
    out = G.band_join(a, b, ["k"], {("x", "y"): 5})
    assert rows(out, "a") == [("a1",)]


def test_interval_lookup(spark):
    ids = spark.createDataFrame([(0,), (2,), (3,), (9,)], "id long")
    bounds = spark.createDataFrame([("a", 2), ("b", 3)], "owner string, n long")
    out = G.interval_lookup(ids, bounds, "owner", "n")
    assert rows(out, "id", "owner") == [(0, "a"), (2, "a"), (3, "b"), (9, None)]


def test_result_diff_unordered_and_ordered(spark):
    from spogrid.operators.metrics import ordered_diff, result_diff

    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    b = spark.createDataFrame([(2,), (3,), (3,), (1,)], "x int")
    got = rows(result_diff(a, b), "x", "expected", "actual")
    assert got == [(2, 2, 1), (3, 1, 2)]
    d = ordered_diff(a.orderBy("x"), b.orderBy("x"))
    assert sorted(r.pos for r in d.collect()) == [2]
