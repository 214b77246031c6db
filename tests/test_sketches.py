"""Sketches of predicates: merged ones equal those of all triples, and order joins."""

import pytest
from pyspark.sql import functions as F

from spogrid.functions.terms import TRIPLE_SCHEMA
from spogrid.operators import sketches
from tests.conftest import _row


def test_merged_sketches_and_sizes(spark):
    data = [_row(f"s/{k}", "p:wide", f"o/{k % 50}") for k in range(20000)] + [_row(f"s/{k}", "p:num", str(k), dt="xsd:integer", num=float(k)) for k in range(5000)]
    old = spark.createDataFrame(data, TRIPLE_SCHEMA)
    new = spark.createDataFrame([_row(f"s/{k}", "p:wide", "o/1") for k in range(19000, 25000)] + [_row("s/1", "p:new", "o/1")], TRIPLE_SCHEMA)
    merged = sketches.merge(sketches.sketch(old), sketches.sketch(new))
    got = {r["pred"]: r for r in sketches.estimates(merged).collect()}
    assert {p: r["n"] for p, r in got.items()} == {"p:wide": 26000, "p:num": 5000, "p:new": 1}
    assert got["p:wide"]["n_sub"] == pytest.approx(25000, rel=0.03) and got["p:wide"]["n_obj"] == 50
    assert got["p:num"]["median"] == pytest.approx(2500, abs=250) and got["p:new"]["median"] is None
    whole = {r["pred"]: r["n_sub"] for r in sketches.estimates(sketches.sketch(old.union(new))).collect()}
    assert {p: r["n_sub"] for p, r in got.items()} == pytest.approx(whole, rel=0.02)
    sizes = sketches.pattern_sizes([("?s", "p:wide", "?o"), ("?s", "p:wide", "o/7"), ("s/1", "p:num", "?n"), ("?s", "?p", "?o"), ("?s", "p:none", "?o")], merged)
    assert sizes[0] == 26000 and sizes[1] == pytest.approx(520) and sizes[2] == pytest.approx(1, rel=0.03) and sizes[3:] == [31001, 0]


def test_no_triples(spark):
    none = sketches.sketch(spark.createDataFrame([], TRIPLE_SCHEMA))
    assert sketches.merge(none, none).count() == 0 and sketches.estimates(none).count() == 0
    one = sketches.sketch(spark.createDataFrame([_row("a", "p:x", "b")], TRIPLE_SCHEMA))
    assert [r["n_sub"] for r in sketches.estimates(sketches.merge(none, one).union(sketches.merge(one, none))).where(F.col("n") == 1).collect()] == [1, 1]


def test_exact_counts_move_a_value_once(spark):
    from spogrid.plans import storage
    from spogrid.sources.tables import Tables

    got = storage.sketch_stats(Tables.get(spark, "/root/testdata/sf0.001"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "bit_or" in plan  # not once for each predicate and count
    assert {(r.subjects_near, r.objects_near, r.median_near) for r in got.collect()} == {(True, True, True)}
