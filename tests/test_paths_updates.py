from pyspark.sql import functions as F

from spogrid.operators.paths import alt, closure, inv, levels, path, seq
from spogrid.functions.terms import TRIPLE_SCHEMA, Lit
from spogrid.operators.updates import construct, delete_data, delete_where, describe, insert_data
from spogrid.streaming.updates import UPDATE_SCHEMA, apply_batch, apply_update_stream, base_path, compact, current
from tests.conftest import rows


def test_closure_terminates_on_cycles(graph):
    edges = graph.where("pred = 'rdfs:subClassOf'").select(F.col("sub").alias("child"), F.col("obj").alias("parent"))
    c = closure(edges)
    got = rows(c, "child", "ancestor", "depth")
    assert ("type/A", "type/C", 2) in got and ("type/A", "type/A", 3) in got
    assert len(got) == 9


def test_levels(spark):
    e = spark.createDataFrame([("a", "root"), ("b", "a"), ("c", "b")], "child string, parent string")
    assert rows(levels(e), "node", "depth") == [("a", 1), ("b", 2), ("c", 3), ("root", 0)]


def test_paths(graph):
    s = path(graph, "?r", seq("shop:reviewFor", "shop:producer"), "?pr")
    assert rows(s, "r", "pr") == [("review/1", "producer/1")]
    i = path(graph, "?p", inv("shop:reviewFor"), "?r")
    assert rows(i, "p", "r") == [("product/1", "review/1")]
    a = path(graph, "?x", alt("rdfs:label", "rev:text"), "?t")
    assert len(rows(a, "x", "t")) == 4
    m = path(graph, "?pr", seq(inv("shop:producer"), inv("shop:reviewFor")), "?r")
    assert rows(m, "pr", "r") == [("producer/1", "review/1")]


def test_construct_is_a_set(graph):
    sol = graph.where("pred = 'shop:producer'").select(F.col("sub").alias("p"), F.col("obj").alias("m"))
    out = construct(sol, [("?m", "ex:makes", "?p"), ("?m", "ex:kind", "ex:Maker")])
    assert out.count() == 3


def test_describe(graph, spark):
    ids = spark.createDataFrame([("product/2",)], "x string")
    assert describe(graph, ids).count() == 5


def test_insert_has_set_semantics_and_delete_where(graph):
    dup = graph.where("sub = 'product/1'")
    assert insert_data(graph, dup.unionByName(dup)).count() == graph.count()
    out = delete_where(graph, [("?p", "shop:num", 3), ("?p", "?x", "?y")])
    assert out.where("sub = 'product/2'").count() == 0
    assert out.count() == graph.count() - 5


def _tx(spark, rows_):
    return spark.createDataFrame(rows_, UPDATE_SCHEMA)


def test_stream_equals_batch(spark, graph, tmp_path):
    t = lambda s, p, o, op, n: (s, p, o, "iri", None, None, None, None, op, n)
    tx = _tx(
        spark,
        [
            t("a/1", "ex:p", "b/1", "insert", 1),
            t("a/2", "ex:p", "b/2", "insert", 1),
            t("product/1", "shop:producer", "producer/1", "delete", 2),
            t("a/2", "ex:p", "b/2", "delete", 3),
        ],
    )
    batch = apply_batch(graph, tx)
    root = str(tmp_path)
    graph.write.parquet(base_path(f"{root}/store"))
    for n in (1, 2, 3):
        tx.where(F.col("txn") == n).write.mode("append").parquet(f"{root}/in")
    apply_update_stream(spark, f"{root}/in", f"{root}/store", f"{root}/ckpt", files_per_batch=1)
    streamed = current(spark, f"{root}/store")
    assert rows(streamed, "sub", "pred", "obj") == rows(batch, "sub", "pred", "obj")
    got = rows(streamed, "sub", "pred", "obj")
    assert ("a/1", "ex:p", "b/1") in got and ("a/2", "ex:p", "b/2") not in got


def test_late_transactions_lose(spark, graph, tmp_path):
    t = lambda op, n: ("a/1", "ex:p", "b/1", "iri", None, None, None, None, op, n)
    root = str(tmp_path)
    graph.write.parquet(base_path(f"{root}/store"))
    for k, row in enumerate([t("insert", 1), t("delete", 5), t("insert", 3)]):
        _tx(spark, [row]).coalesce(1).write.parquet(f"{root}/in/{k}")
    for k in range(3):  # one batch each, the late one last
        apply_update_stream(spark, f"{root}/in/{k}", f"{root}/s{k}", f"{root}/ckpt{k}")
        spark.read.parquet(f"{root}/s{k}/delta/epoch=0").write.mode("overwrite").parquet(f"{root}/store/delta/epoch={k}")
    assert current(spark, f"{root}/store").where("sub = 'a/1'").count() == 0
    compact(spark, f"{root}/store", f"{root}/packed")
    _tx(spark, [t("insert", 4)]).write.parquet(f"{root}/packed/delta/epoch=9")
    assert current(spark, f"{root}/packed").where("sub = 'a/1'").count() == 0
    _tx(spark, [t("insert", 6)]).write.parquet(f"{root}/packed/delta/epoch=10")
    assert current(spark, f"{root}/packed").where("sub = 'a/1'").count() == 1


def test_updates_compare_whole_terms(spark):
    row = lambda obj, kind, dt, lang: ("a", "p", obj, kind, dt, lang, None, None)
    frame = lambda *r: spark.createDataFrame(list(r), TRIPLE_SCHEMA)
    fr, en, plain, typed, iri = row("chat", "lit", None, "fr"), row("chat", "lit", None, "en"), row("chat", "lit", None, None), row("chat", "lit", "xsd:string", None), row("chat", "iri", None, None)
    store = frame(fr)
    assert insert_data(store, frame(en)).count() == 2
    assert insert_data(store, frame(row("chat", "lit", None, "FR"))).count() == 1
    assert insert_data(frame(plain), frame(typed, typed, iri)).count() == 2
    assert delete_data(store, frame(en)).count() == 1 and delete_data(store, frame(fr)).count() == 0
    both = frame(fr, en, plain, iri)
    left = delete_where(both, [("?s", "p", Lit("chat"))]).collect()
    assert sorted((r["kind"], r["lang"] or "") for r in left) == [("iri", ""), ("lit", "en"), ("lit", "fr")]
    left = delete_where(both, [("?s", "p", Lit("chat", lang="en"))]).collect()
    assert len(left) == 3 and not [r for r in left if r["lang"] == "en"]


def test_delete_where_meets_rows_before_their_triples(spark):
    from spogrid.sources.store import TripleStore
    from spogrid.sources.triplify import int_lit, iri, iri_obj, string_lit, typed

    things = spark.createDataFrame([(k, f"n{k}" if k % 3 else None, k % 4) for k in range(20)] + [(None, "lost", 1)], "nr long, name string, size int")
    links = spark.createDataFrame([(k, k % 3) for k in range(20)] * 2, "nr long, to int")
    s = iri("thing/", "nr")
    parts = [typed(things, s, "c:Thing"), string_lit(things, s, "c:name", "name"), int_lit(things, s, "c:size", "size"), iri_obj(links, s, "c:to", iri("thing/", "to"))]
    store = TripleStore.from_branches(parts)
    patterns = [("?s", "c:size", 1), ("?s", "?p", "?o")]
    out = delete_where(store, patterns)
    told = lambda df: sorted(map(repr, df.select(*TRIPLE_SCHEMA.names).collect()))
    assert told(out) == told(delete_where(store.all, patterns)) and 0 < len(told(out)) < len(told(store.all))
    plan = out.where(F.col("pred").isin("c:name", "c:size"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_steps_through_a_node_of_one_value_are_one(spark):
    from pyspark.sql import functions as F

    from spogrid.operators import paths as P
    from spogrid.sources.store import TripleStore
    from spogrid.sources.triplify import branch, iri, iri_obj

    review = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 2, 2), (4, 3, 2), (5, 4, 4), (6, None, 1), (7, 5, None)], "nr long, p long, w long")
    links = spark.createDataFrame([(1, 1), (1, 2)], "nr long, p long")
    r = iri("review/", "nr")
    one = [iri_obj(review, r, "p:for", iri("product/", "p")), iri_obj(review, r, "p:by", iri("person/", "w"))]
    store = TripleStore.from_branches([*one, iri_obj(links, iri("list/", "nr"), "p:many", iri("product/", "p"), False), branch(review, r, "p:text", F.col("nr").cast("string"))])
    steps = P._Steps(store)
    assert steps.one_value("p:for") and not steps.one_value("p:many") and not steps.one_value("p:none")
    both = P.seq(P.inv("p:for"), "p:by", P.inv("p:by"), "p:for")
    assert sorted(x.node for x in steps.search(P.plus(both), steps.node("product/1")).collect()) == [f"product/{k}" for k in (1, 2, 3)]
    assert set(steps.edges) == {("p:for", "p:by"), ("p:by", "p:for")}  # no edge names a review
    plain = P._Steps(store.all)
    assert sorted(x.node for x in plain.search(P.plus(both), plain.node("product/1")).collect()) == [f"product/{k}" for k in (1, 2, 3)]
    assert P.between(store, "product/1", P.plus(both), "product/3").collect() == P.between(store.all, "product/1", P.plus(both), "product/3").collect() == [("product/1", "product/3", 2)]
    literal = P._Steps(store)
    assert literal.search(P.Rep(P.seq(P.inv("p:for"), "p:text"), 1, 1), literal.node("product/1")).count() == 0  # a text is no node
