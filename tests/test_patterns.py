import pytest
from pyspark.sql import functions as F

from spogrid.functions.terms import Lit, num
from spogrid.operators.patterns import bgp, substitute, triple_pattern
from tests.conftest import rows


def test_bound_predicate_and_object(graph):
    out = triple_pattern(graph, ("?p", "shop:producer", "producer/1"))
    assert rows(out, "p") == [("product/1",), ("product/2",)]


def test_literal_object_is_not_an_iri(graph):
    assert triple_pattern(graph, ("?p", "rdfs:label", Lit("red gear"))).count() == 1
    assert triple_pattern(graph, ("?p", "rdfs:label", "red gear")).count() == 0


def test_numeric_constant_compares_values(graph):
    assert rows(triple_pattern(graph, ("?p", "shop:num", 7)), "p") == [("product/1",)]


def test_repeated_variable_adds_equality(graph):
    out = triple_pattern(graph, ("?x", "?p", "?x"))
    assert rows(out, "x", "p") == [("node/x", "shop:self")]


def test_variable_predicate(graph):
    out = triple_pattern(graph, ("product/2", "?p", "?o"))
    assert len(rows(out)) == 5


def test_join_uses_every_shared_variable(graph):
    # producer and publisher must be the same ?v: product/2 has different ones
    out = bgp(graph, [("?p", "shop:producer", "?v"), ("?p", "dc:publisher", "?v")])
    assert rows(out, "p", "v") == [("product/1", "producer/1")]


def test_blank_node_is_a_hidden_variable(graph):
    out = bgp(graph, [("_:r", "shop:reviewFor", "?p"), ("_:r", "rev:text", "?t")])
    assert out.columns[:2] == ["p", "t"] or set(["p", "t"]) <= set(out.columns)
    assert not [c for c in out.columns if c.startswith("_b_")]
    assert rows(out, "p", "t") == [("product/1", "Great")]


def test_shared_constant_subject_is_an_equi_join(graph):
    out = bgp(graph, [("product/1", "rdfs:label", "?l"), ("product/1", "shop:num", "?n")])
    assert rows(out, "l", "n") == [("red gear", "7")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in plan


def test_filter_on_typed_value(graph):
    out = bgp(graph, [("?p", "shop:num", "?n")]).where(num("n") > 5)
    assert rows(out, "p") == [("product/1",)]


def test_variable_equality_by_substitution(graph):
    pats = substitute([("?p", "shop:producer", "?a"), ("?p", "dc:publisher", "?b")], {"?b": "?a"})
    assert rows(bgp(graph, pats), "p") == [("product/1",)]


def test_filter_string_functions(graph):
    out = bgp(graph, [("?p", "rdfs:label", "?l")]).where(F.col("l").rlike("^red"))
    assert rows(out, "p") == [("product/1",)]


def _frame(spark, *triples):
    from spogrid.functions.terms import TRIPLE_SCHEMA

    return spark.createDataFrame([(s, p, o, k, dt, lang, None, None) for s, p, o, k, dt, lang in triples], TRIPLE_SCHEMA)


def test_joins_compare_terms(spark):
    t = _frame(
        spark,
        ("a", "p", "x", "lit", "xsd:string", None), ("b", "q", "x", "iri", None, None), ("c", "q", "x", "lit", None, None),
        ("d", "q", "x", "lit", None, "en"), ("x", "r", "y", "iri", None, None), ("e", "p", "x", "iri", None, None),
    )
    both = bgp(t, [("?s", "p", "?v"), ("?t", "q", "?v")])
    assert rows(both, "s", "t") == [("a", "c"), ("e", "b")]
    chain = bgp(t, [("?s", "p", "?v"), ("?v", "r", "?w")])  # only an IRI is a subject
    assert rows(chain, "s") == [("e",)]


def test_repeated_variable_and_plain_literals(spark):
    t = _frame(spark, ("x", "p", "x", "lit", None, None), ("y", "p", "y", "iri", None, None), ("z", "p", "x", "lit", None, "fr"))
    assert rows(triple_pattern(t, ("?x", "?p", "?x")), "x") == [("y",)]
    assert rows(triple_pattern(t, ("?s", "p", Lit("x"))), "s") == [("x",)]


def test_a_cross_product_must_be_asked_for(graph):
    with pytest.raises(ValueError, match="cross"):
        bgp(graph, [("?a", "rdfs:label", "?b"), ("?c", "shop:producer", "?d")])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_constant_subject_and_object_of_every_entity(spark, sf):
    from spogrid.sources.tables import Tables

    store = Tables(spark, f"/root/testdata/{sf}").store
    for pred in ("rdfs:label", "foaf:name", "shop:price", "dc:title", "rev:reviewer", "rev:text", "shop:reviewDate"):
        one = store.vp(pred).first()
        again = triple_pattern(store, (one["sub"], pred, "?o")).collect()
        assert [r["o"] for r in again] == [one["obj"]]
        known = triple_pattern(store, (one["sub"], "?p", "?o")).collect()
        assert (pred, one["obj"]) in {(r["p"], r["o"]) for r in known} and len(known) >= 2
        back = triple_pattern(store, ("?s", "?p", one["sub"])).collect()
        assert all(r["s"] for r in back)


def test_star_over_a_key_that_is_not_unique(spark):
    from spogrid.sources.store import TripleStore
    from spogrid.sources.triplify import int_lit, iri, string_lit

    src = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "c", 7), (2, "c", 7)], "k int, x string, y int")
    parts = [string_lit(src, iri("n/", "k"), "x", "x"), int_lit(src, iri("n/", "k"), "y", "y")]
    store = TripleStore.from_branches(parts)
    star = [("?s", "x", "?x"), ("?s", "y", "?y")]
    assert store.all.count() == 6
    assert rows(bgp(store, star), "s", "x", "y") == rows(bgp(store.all, star), "s", "x", "y")
    assert len(rows(bgp(store, star), "s", "x", "y")) == 5
