"""Steps that must not move whole texts or all triples: stored layout, profiles, summaries, updates, lookups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spogrid.functions.terms import TRIPLE_SCHEMA
from spogrid.operators import extvp, updates
from spogrid.operators.aggregates import summary
from spogrid.operators.algebra import interval_lookup
from spogrid.sources import textio
from spogrid.sources.store import WRITERS, TripleStore, load_triples, write_triples
from tests.conftest import _row, rows


def _store(spark):
    """Offers of products, and products of a type, with a text each."""
    from spogrid.sources.triplify import branch, iri, iri_obj

    offer = spark.createDataFrame([(k, k % 3, f"text {k % 2}") for k in range(20)], "nr long, product long, text string")
    product = spark.createDataFrame([(k, "t") for k in range(4)], "nr long, type string")
    o, p = iri("offer/", "nr"), iri("product/", "nr")
    parts = [iri_obj(offer, o, "p:product", iri("product/", "product")), branch(offer, o, "p:text", F.col("text"))]
    return TripleStore.from_branches(parts + [iri_obj(product, p, "p:type", iri("type/", "type")), branch(product, p, "p:label", F.col("type"))])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_virtual_store_is_written_where_it_is_made(spark, tmp_path, monkeypatch):
    store, before, seen = _store(spark), spark.conf.get(WRITERS, None), []
    from spogrid.sources import store as module

    layout = module._layout
    monkeypatch.setattr(module, "_layout", lambda df, *a: (seen.append((_plan(df), spark.conf.get(WRITERS))), layout(df, *a)))
    write_triples(store, str(tmp_path / "vp"))
    (plan, writers), = seen
    assert "Exchange" not in plan and "Sort" not in plan and int(writers) > 0
    assert spark.conf.get(WRITERS, None) == before
    assert rows(load_triples(spark, str(tmp_path / "vp")).all) == rows(store.all)


def test_profiles_are_few_and_give_the_same_statistics(spark):
    store = _store(spark)
    table = TripleStore.from_table(store.all)
    assert rows(extvp.reduction_stats(store)) == rows(extvp.reduction_stats(table)) == rows(extvp.reduction_stats(store, extvp.reduction_rows(store)))
    assert extvp.value_profiles(store).where("side = 'S'").count() < 6  # 24 subjects
    from spogrid.sources.triplify import iri, iri_obj

    lost = TripleStore.from_branches([iri_obj(spark.createDataFrame([(k, k) for k in (None, None, 1, 2)], "n long, m long"), iri("a/", "n"), p, iri("a/", "m")) for p in ("p:x", "p:y")]
                                     + [iri_obj(spark.range(3), F.lit(None).cast("string"), "p:z", iri("a/", "id"))])
    assert rows(extvp.reduction_stats(lost)) == rows(extvp.reduction_stats(lost, extvp.reduction_rows(lost)))
    assert {r.p1: r.vp_size for r in extvp.reduction_stats(lost).collect()} == {"p:x": 2, "p:y": 2, "p:z": 3}
    twice = TripleStore.from_branches([iri_obj(df.union(df), iri("a/", "n"), "p:x", iri("a/", "n")) for df in [spark.range(3).withColumnRenamed("id", "n")]])
    assert rows(extvp.reduction_counts(twice, ["OS"])) == [("OS", "p:x", "p:x", 3)]


def test_values_are_grouped_with_one_item_a_row(spark):
    store = _store(spark)
    sizes = {r["v"]: r["n"] for r in extvp._value_items(store).groupBy("v").agg(F.max(F.size("items")).alias("n")).collect()}
    assert set(sizes.values()) == {1} and {f"offer/{k}" for k in range(20)} <= set(sizes)
    assert rows(extvp.reduction_stats(store)) == rows(extvp.reduction_stats(store.all))


def test_joined_source_is_counted_by_its_sides(spark, monkeypatch):
    from spogrid.sources import store as module
    from spogrid.sources.triplify import branch, iri

    counted, count = [], module._no_key_twice
    monkeypatch.setattr(module, "_no_key_twice", lambda source, keys: counted.append(id(source)) or count(source, keys))
    base = spark.createDataFrame([(k, k % 3) for k in range(9)], "nr long, doc long")
    for ids, once in (([0, 1, 2, None], True), ([0, 1, 1, 2], False)):
        side = spark.createDataFrame([(k, f"text {k}") for k in ids], "doc long, text string")
        wider = base.join(side, "doc")
        b = branch(wider, iri("review/", "nr"), "rev:text", F.col("text"))
        store = TripleStore.from_branches([b])
        store.extend(wider, base, side, "doc")
        counted.clear()
        assert store.unique(b) is once and store.unique(b) is once
        assert counted == [id(base), id(side)] + ([] if once else [id(wider)])


def test_keys_are_told_apart_by_value(spark, monkeypatch):
    from spogrid.sources.store import _no_key_twice

    keys = [F.col("a"), F.col("b")]
    frame = lambda *r: spark.createDataFrame(r, "a long, b string")
    assert _no_key_twice(frame((1, "x"), (1, "y"), (2, "x"), (None, "x"), (None, None)), keys)
    assert not _no_key_twice(frame((1, "x"), (None, "x"), (None, "x")), keys)
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))  # all hashes clash
    assert _no_key_twice(frame((1, "x"), (1, "y"), (None, "x")), keys)
    assert not _no_key_twice(frame((1, "x"), (1, "y"), (1, "x")), keys)


def test_summary_counts_distinct_values_of_many_groups(spark):
    df = spark.range(1000).select((F.col("id") % 130).alias("g"), F.lit("k").alias("h"), F.when(F.col("id") % 13 > 0, F.col("id") % 7).alias("v"), F.col("id").cast("string").alias("t"))
    aggs = {"n": F.count(F.lit(1)), "low": F.min("t"), "high": F.max("t")}
    plain = df.groupBy("g", "h").agg(*[c.alias(k) for k, c in aggs.items()], F.countDistinct("v").alias("d"))
    got = summary(df, ["g", "h"], {"d": "v"}, aggs)
    assert rows(got.select(*plain.columns)) == rows(plain)
    assert summary(df.where("g < 0"), ["g", "h"], {"d": "v"}, aggs).count() == 0


def test_texts_are_written_in_bounded_compressed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textio, "FILE_LINES", 100)
    triples = spark.createDataFrame([_row(f"s/{k}", "p:a", f"o/{k}") for k in range(450)], TRIPLE_SCHEMA).coalesce(1)
    textio.write_ntriples(triples, str(tmp_path / "nt"))
    files = [f.name for f in (tmp_path / "nt").glob("part-*")]
    assert len(files) == 5 and all(f.endswith(".gz") for f in files)
    assert textio.read_ntriples(spark, str(tmp_path / "nt")).count() == 450


def test_updates_join_only_the_predicates_they_touch(spark):
    data = [_row(f"s/{k}", p, f"o/{k}") for k in range(5) for p in ("p:a", "p:b", "p:c")]
    triples = spark.createDataFrame(data, TRIPLE_SCHEMA)
    out = updates.delete_data(triples, triples.where("pred = 'p:a' AND sub < 's/2'"))
    assert rows(out.groupBy("pred").count()) == [("p:a", 3), ("p:b", 5), ("p:c", 5)]
    assert "Union" in out._jdf.queryExecution().analyzed().toString()  # one part is joined, one passes
    assert updates.delete_data(triples, triples.where("false")).count() == 15
    new = triples.where("sub = 's/1'").unionByName(spark.createDataFrame([_row("s/9", "p:z", "o/1")], TRIPLE_SCHEMA))
    assert updates.insert_data(triples, new).count() == 16


def test_lookup_reads_each_frame_once(spark):
    ids = spark.createDataFrame([(k,) for k in [*range(1, 60), 7, 7]] + [(None,)], "id long")
    bounds = spark.createDataFrame([(o, 10) for o in range(5)] + [(5, 0)], "owner int, n long")
    out = interval_lookup(ids, bounds, "owner", "n")
    assert sorted((r.id, r.owner) for r in out.where("id IS NOT NULL").collect()) == sorted((k, (k - 1) // 10 if k <= 50 else None) for k in [*range(1, 60), 7, 7])
    # a frame from the row to the end of the partition is read again for each row
    assert "RowFrame, currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("key", ["triplify"])
def test_summary_of_the_store(spark, key):
    from spogrid.plans import graph_io

    store = _store(spark)
    plain = store.all.groupBy("pred").agg(F.count("*").alias("n"), F.countDistinct("sub").alias("n_sub"), F.min("obj").alias("min_obj"), F.max("obj").alias("max_obj"))
    assert rows(getattr(graph_io, key)(store)) == rows(plain)


def test_rows_that_stand_apart_are_not_shuffled_by_value(spark):
    from spogrid.sources.triplify import iri, iri_obj

    store = _store(spark)
    groups = store.sources()
    assert [extvp._apart(store, g) for g in groups] == [True, False]  # products are objects of offers
    left = extvp._value_items(store, [0]).select("v").collect()
    assert {r.v for r in left} == {f"product/{k}" for k in range(4)}
    assert rows(extvp.value_profiles(store).groupBy("side").agg(F.sum("n"))) == [("O", 20), ("S", 24)]
    # an object, or another source's subject, that may be an offer
    for other in (iri_obj(spark.range(2), iri("x/", "id"), "p:of", iri("offer/", "id")), iri_obj(spark.range(2), iri("offer/", "id"), "p:z", iri("y/", "id"))):
        shared = TripleStore.from_branches([*groups[0], *groups[1], other])
        assert not extvp._apart(shared, shared.sources()[0])
        assert rows(extvp.reduction_stats(shared)) == rows(extvp.reduction_stats(TripleStore.from_table(shared.all)))
    # null subjects meet nothing; a store of one such source has nothing to shuffle
    alone = TripleStore.from_branches([iri_obj(spark.createDataFrame([(None, 1), (1, 2), (2, None)], "n long, m long"), iri("a/", "n"), "p:x", iri("b/", "m"))])
    assert extvp._value_items(alone, [0]) is None
    assert rows(extvp.value_profiles(alone).select("side", "n")) == [("N", 1), ("S", 1)]


def test_rows_meet_their_order_before_their_triples_are_made(spark):
    from types import SimpleNamespace

    from spogrid.sources import quads as Q
    from spogrid.sources.triplify import branch, iri

    tables = SimpleNamespace(orders=spark.createDataFrame([(1, "1-URGENT"), (2, None)], "o_orderkey long, o_orderpriority string"))
    offer = spark.createDataFrame([("1-1", "a", "b"), ("2-1", "a", None), ("3-1", None, "b"), (None, "a", "b")], "nr string, x string, y string")
    other = spark.createDataFrame([("1-1", "a")], "nr string, x string")
    parts = [branch(offer, iri("offer/", "nr"), p, F.col(c)) for p, c in (("p:x", "x"), ("p:y", "y"))] + [branch(other, iri("thing/", "nr"), "p:x", F.col("x"))]
    quads = Q.order_graphs(tables, TripleStore.from_branches(parts))
    plain = Q.order_graphs(tables, TripleStore.from_branches(parts).all)
    assert rows(quads.select("sub", "pred", "obj", "graph")) == rows(plain.select("sub", "pred", "obj", "graph"))
    assert rows(quads.groupBy("graph").count()) == [("graph/1-URGENT", 2), ("graph/default", 3)]
    lines = quads._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins, made = ([k for k, line in enumerate(lines) if word in line] for word in ("Join", "Generate"))
    assert len(joins) == 1 and made[0] < joins[0]  # the triples are made above the join


def test_long_texts_are_read_back_once(spark):
    from spogrid.plans import graph_io

    long = 'a "quoted"\ttext\\ of\n' * 40
    terms = [(long, "xsd:string", None)] * 5 + [(long, None, "en")] * 2 + [("short", "xsd:string", None), ("7", "xsd:integer", None)]
    t = spark.createDataFrame([(f"s/{k}", "p:t", o, "lit", dt, lang, None, None) for k, (o, dt, lang) in enumerate(terms)] + [_row("s/0", "p:l", "o/" + "x" * 300)], TRIPLE_SCHEMA)
    got = graph_io.literal_parse(t)
    assert Counter(map(tuple, got.collect())) == Counter([("lit", "xsd:string", None, 6, 6), ("lit", None, "en", 2, 2), ("lit", "xsd:integer", None, 1, 1), ("iri", None, None, 1, 1)])
    assert "text" not in got.columns and got._jdf.queryExecution().analyzed().toString().count("Aggregate") == 2


def test_columns_that_nobody_asks_for_do_not_move(spark):
    from types import SimpleNamespace

    from spogrid.sources import quads as Q
    from spogrid.sources.store import explode_branches
    from spogrid.sources.triplify import branch, iri, iri_obj

    tables = SimpleNamespace(orders=spark.createDataFrame([(k, "1-URGENT") for k in range(3)], "o_orderkey long, o_orderpriority string"))
    review = spark.createDataFrame([(f"{k % 3}-{k}", f"text {k}" if k % 2 else None, k) for k in range(9)] + [(None, "x", 1)], "nr string, text string, product long")
    r = iri("review/", "nr")
    store = TripleStore.from_branches([branch(review, r, "p:text", F.col("text"), lang=F.lit("en")), iri_obj(review, r, "p:of", iri("product/", "product"))])
    quads = Q.order_graphs(tables, store)
    counted = quads.groupBy("graph", "pred").count()
    join = next(x for x in counted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    moved = [x for x in plan[plan.index(join) :].splitlines() if "Project" in x and "__mask" in x]
    assert moved and not any("text#" in x.split("[", 1)[1].rsplit("]", 1)[0].split(" AS ")[-1] for x in moved)
    assert rows(counted) == [("graph/1-URGENT", "p:of", 9), ("graph/1-URGENT", "p:text", 4)]
    # as many branches as no mask tells apart give the same triples
    many = [iri_obj(review, r, f"p:{k}", iri("product/", "product")) for k in range(70)]
    assert explode_branches(review, many).count() == 700
    assert Counter(tuple(x) for x in store.all.collect()) == Counter(tuple(x) for b in store.sources()[0] for x in store._frame(b).collect())


def test_subjects_are_stored_once_for_a_row(spark, tmp_path):
    from spogrid.sources.triplify import branch, iri, iri_obj, typed

    thing = spark.createDataFrame([(k, f"n {k}" if k % 3 else None, k % 4) for k in range(30)] + [(None, "lost", 1)], "nr long, name string, kind long")
    again = spark.createDataFrame([(k % 5, "x") for k in range(20)], "nr long, note string")
    s, a = iri("thing/", "nr"), iri("again/", "nr")
    parts = [typed(thing, s, "c:Thing"), iri_obj(thing, s, "rdf:type", iri("kind/", "kind")), branch(thing, s, "p:name", F.col("name"), lang=F.lit("en"))]
    parts += [branch(thing, iri("other/", "kind"), "p:name", F.col("name")), typed(again, a, "c:Again"), branch(again, a, "p:name", F.col("note"), num=F.lit(2))]
    for store in (TripleStore.from_branches(parts), TripleStore.from_branches(parts[:3] + parts[4:])):
        path = str(tmp_path / f"vp{len(store.sources()[0])}")
        write_triples(store, path)
        stored = load_triples(spark, path)
        told = lambda df: Counter(map(tuple, df.select(*TRIPLE_SCHEMA.names).collect()))
        assert told(stored.all) == told(store.all) and sorted(stored.predicates()) == ["p:name", "rdf:type"]
        assert told(stored.vp("p:name")) == told(store.vp("p:name")) == told(stored.only(["p:name", "p:none"])) and stored.vp("p:none").count() == 0
        held = spark.read.parquet(f"{path}/triples").where("pred LIKE 'rows%'")
    # a row of three predicates has its subject once; counts read neither subjects nor objects
    assert held.count() == 31 and stored.only(["rdf:type", "p:name"]).count() == 62 + 21 + 10
    scan = [x for x in _plan(stored.all.groupBy("pred").count()).splitlines() if "FileScan" in x]
    assert scan and not any("sub#" in x or "obj_" in x for x in scan)
