"""Path closures, as-of joins, set operations, groupings, ranks and streams, against plain versions."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spogrid.functions.terms import TRIPLE_SCHEMA
from spogrid.operators import paths
from spogrid.operators.aggregates import grouped_sets, neighbours, ranked
from spogrid.operators.algebra import as_of, intersect, minus
from spogrid.operators.paths import Rep, alt, between, inv, neg, opt, path, plus, seq, star
from spogrid.plans import time_q
from spogrid.sources.tables import Tables
from spogrid.streaming import windows as W
from tests.conftest import SMOKE, _row


def edges(n=14, m=22, seed=4):
    """A graph with cycles, a self-loop, a branch that nothing leads back from, and an unlinked node."""
    rng = random.Random(seed)
    found = {(rng.randrange(n), rng.choice("pq"), rng.randrange(n)) for _ in range(m)}
    return sorted(found | {(0, "p", 0), (n, "p", n + 1), (n + 2, "q", n + 2)})


@pytest.fixture(scope="module")
def net(spark):
    rows = [_row(f"n/{a}", p, f"n/{b}") for a, p, b in edges()] + [_row("n/1", "p", "a literal", kind="lit"), _row("n/1", "label", "x", kind="lit")]
    return spark.createDataFrame(rows, TRIPLE_SCHEMA)


def one_step(e):
    """Pairs of nodes that a path of single steps links."""
    if isinstance(e, str):
        return {(a, b) for a, p, b in edges() if p == e}
    if isinstance(e, paths.Inv):
        return {(b, a) for a, b in one_step(e.part)}
    if isinstance(e, paths.Alt):
        return set().union(*map(one_step, e.parts))
    if isinstance(e, paths.Seq):
        out = one_step(e.parts[0])
        for p in e.parts[1:]:
            out = {(a, c) for a, b in out for x, c in one_step(p) if b == x}
        return out
    out = {(a, b) for a, p, b in edges() if p not in e.parts} if e.parts or not e.inverse else set()
    return out | ({(b, a) for a, p, b in edges() if p not in e.inverse} if e.inverse else set())


def walked(e, start):
    """Least number of steps to each node, none not counted."""
    links, found, front, n = one_step(e), {}, {start}, 0
    while front:
        n += 1
        front = {b for a, b in links if a in front} - set(found)
        found |= dict.fromkeys(front, n)
    return found


STEPS = ["p", alt("p", "q"), inv("p"), seq("p", "q"), seq(inv("q"), "p"), neg("label", "q"), neg("label", "p", inverse=("label", "q"))]


@pytest.mark.parametrize("k", range(len(STEPS)))
def test_closures_from_either_end(net, k):
    e = STEPS[k]
    got = lambda df, v: sorted(r[v] for r in df.select(v).collect())
    reached = walked(e, k % 4)
    assert got(path(net, f"n/{k % 4}", plus(e), "?x"), "x") == sorted(f"n/{b}" for b in reached)
    assert got(path(net, "n/0", star(e), "?x"), "x") == sorted({f"n/{b}" for b in walked(e, 0)} | {"n/0"})
    back = sorted({f"n/{a}" for a in range(17) if 3 in walked(e, a)} | {"n/3"})
    assert got(path(net, "?x", star(e), "n/3"), "x") == back
    once = {f"n/{b}" for a, b in one_step(e) if a == 3} | {"n/3"}
    assert got(path(net, "n/3", opt(e), "?x"), "x") == sorted(once)


def test_a_bound_end_that_the_graph_lacks_reaches_itself(net):
    assert [r["x"] for r in path(net, "n/none", star("p"), "?x").collect()] == ["n/none"]
    assert path(net, "n/none", plus("p"), "?x").count() == 0


def test_closures_with_both_ends_unbound(net):
    pairs = {(f"n/{a}", f"n/{b}") for a in range(17) for b in walked("p", a)}
    assert {(r["x"], r["y"]) for r in path(net, "?x", plus("p"), "?y").collect()} == pairs
    nodes = {f"n/{k}" for a, _, b in edges() for k in (a, b)}
    found = path(net, "?x", star("p"), "?y").select("x", "y").collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == pairs | {(x, x) for x in nodes}
    assert {r["x"] for r in path(net, "?x", plus("p"), "?x").collect()} == {a for a, b in pairs if a == b}


def test_the_way_between_two_nodes(net):
    for e in ("p", alt("p", "q"), inv("q")):
        for a in (0, 14):
            reached = walked(e, a)
            for b in (0, 3, 15):
                got = [tuple(r) for r in between(net, f"n/{a}", plus(e), f"n/{b}").collect()]
                assert got == ([(f"n/{a}", f"n/{b}", reached[b])] if b in reached else [])
    assert between(net, "n/5", star("p"), "n/5").first()["steps"] == 0
    with pytest.raises(ValueError):
        between(net, "n/1", Rep("p", 2), "n/2")


def test_large_frontiers_are_joined(net, monkeypatch):
    monkeypatch.setattr(paths, "PUSHED", 1)
    assert sorted(r["x"] for r in path(net, "n/0", plus(alt("p", "q")), "?x").collect()) == sorted(f"n/{b}" for b in walked(alt("p", "q"), 0))


# -- as-of joins, sets, groupings, ranks -------------------------------------------------------------

def test_as_of_join_with_a_hot_key(spark):
    rng = random.Random(8)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = [(k, key(), rng.choice([None, *range(400)])) for k in range(1500)]
    right = [(k, key(), rng.choice([None, *range(0, 400, 3)]), f"v{k}") for k in range(900)]
    got = as_of(spark.createDataFrame(left, "id long, k int, t int"), spark.createDataFrame(right, "rid long, rk int, rt int, id string"), "k", "t", "rk", "rt", ["rid", "id"], "rid")
    assert got.columns == ["id", "k", "t", "rid", "right_id"]
    want = []
    for i, k, t in left:
        best = max(((rt, rid, v) for rid, rk, rt, v in right if k is not None and rk == k and t is not None and rt is not None and rt <= t), default=(None, None, None))
        want.append((i, k, t, best[1], best[2]))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_set_operations_tell_terms_apart(spark):
    schema = "v string, v__lang string"
    a = spark.createDataFrame([("x", "en"), ("x", "en"), ("x", None), (None, None), (None, None), ("y", None)], schema)
    b = spark.createDataFrame([("x", "en"), (None, None), ("z", None)], schema)
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(intersect(a, b)) == Counter([("x", "en"), (None, None)])
    assert rows(intersect(a, a, bag=True)) == rows(a)
    assert rows(minus(a, b)) == Counter([("x", None), ("y", None)])
    assert rows(minus(a, b, bag=True)) == Counter([("x", "en"), ("x", None), (None, None), ("y", None)])
    with pytest.raises(ValueError):
        intersect(a, b.drop("v__lang"))


def test_unbound_is_not_a_subtotal(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "g", 1), ("b", None, 2), (None, "g", 3)], "t string, g string, c int")
    got = grouped_sets(df, [("t", "g"), ("t",), ()], {"n": F.count(F.lit(1)), "people": F.countDistinct("c")}).collect()
    assert {(r["t"], r["g"], r["grouping"]): (r["n"], r["people"]) for r in got} == {
        ("a", None, 0): (1, 1), ("a", "g", 0): (1, 1), ("b", None, 0): (1, 1), (None, "g", 0): (1, 1),
        ("a", None, 1): (2, 1), ("b", None, 1): (1, 1), (None, None, 1): (1, 1), (None, None, 3): (4, 3),
    }


def test_global_ranks_with_ties(spark):
    rng = random.Random(1)
    values = [rng.choice([None, *range(40)]) for _ in range(700)]
    got = ranked(spark.createDataFrame([(v,) for v in values], "v int"), ["v"], "r")
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    distinct = list(dict.fromkeys(order))
    assert Counter(map(tuple, got.collect())) == Counter((v, order.index(v) + 1, distinct.index(v) + 1) for v in values)
    # windows without a partition see one row for each range, those over values are within a range
    assert "rangepartitioning" not in ranked(spark.createDataFrame([(1,)], "v int"), ["v"], "r")._jdf.queryExecution().executedPlan().toString()


# -- streams -----------------------------------------------------------------------------------------

def stream_of(spark, tmp_path, batches, schema):
    path_ = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path_)
    return W.files_in_order(spark, path_, spark.createDataFrame([], schema).schema)


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "ts timestamp, k string"
    batches = [[(at(1), "a"), (at(70), "a")], [(at(75), "b")], [(at(2), "a"), (at(71), "a")], [(at(2000), None)], [(at(4000), None)]]
    windowed = lambda df: W.windowed(df, "ts", "10 minutes", W.tumbling("ts", "30 minutes"), ["k"], {"n": F.count(F.lit(1))})
    stream = windowed(stream_of(spark, tmp_path, batches, schema))
    q = W.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    shown = lambda df: Counter((r["start"], r["k"], r["n"]) for r in df.where("k IS NOT NULL").collect())
    got = shown(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))
    assert got == Counter([(at(0), "a", 1), (at(60), "a", 2), (at(60), "b", 1)])
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 1
    on_time = [r for b in batches for r in b if r != (at(2), "a")]
    assert got == shown(windowed(spark.createDataFrame(on_time, schema)))
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_stream_join_equals_the_batch_join_and_lets_go_of_its_state(spark):
    tables = Tables.get(spark, SMOKE)
    got = Counter(map(tuple, time_q.interval_stream_join(tables).collect()))
    e = time_q._events(tables)
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("at"))
    b = e.where("event_type <> 'error'").select("user_id", "event_id", "ts", "event_type")
    want = W.interval_join(a, b, "user_id", "at", "ts", "1 hour", "1 HOUR").select("user_id", "error_id", "event_id", "event_type")
    assert got == Counter(map(tuple, want.collect()))


def test_joined_state_shrinks(spark, tmp_path):
    left = stream_of(spark, tmp_path / "a", [[(k % 3, at(600 * n + k)) for k in range(50)] for n in range(3)], "k int, x timestamp")
    right = stream_of(spark, tmp_path / "b", [[(k % 3, at(600 * n + k + 5)) for k in range(50)] for n in range(3)], "k int, y timestamp")
    q = W.run_to_end(W.interval_join(left, right, "k", "x", "y", "10 minutes", "20 MINUTES"), str(tmp_path / "out"), str(tmp_path / "state"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(held) < 300 and held[-1] <= 100


def test_neighbours_of_a_hot_key(spark):
    rng = random.Random(9)
    data = [(k, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(50)]), rng.choice([None, 1.5, 2.5])) for k in range(400)]
    got = neighbours(spark.createDataFrame(data, "id long, k int, t int, v double").repartition(7), "k", ["t", "id"], "v").collect()
    lag, lead = {}, {}
    for key in {d[1] for d in data}:
        own = sorted((d for d in data if d[1] == key), key=lambda d: (d[2] is not None, d[2] or 0, d[0]))
        for a, b in zip(own, own[1:]):
            lead[a[0]], lag[b[0]] = b[3], a[3]
    assert len(got) == len(data)
    assert all((r["lag_v"], r["lead_v"]) == (lag.get(r["id"]), lead.get(r["id"])) for r in got)
