from pyspark.sql import functions as F

from spogrid.functions import terms as T
from spogrid.sources import textio
from tests.conftest import rows


def test_term_round_trip_with_escapes(spark, graph):
    tricky = spark.createDataFrame(
        [
            ("x/1", "rdfs:label", 'say "hi"\\n and \\\\ back\nslash', "lit", "xsd:string", None, None, None),
            ("x/1", "rev:text", "Grüße", "lit", None, "de", None, None),
            ("x/1", "shop:price", "12.50", "lit", "shop:USD", None, 12.5, None),
            ("x/1", "shop:link", "http://other.org/a", "iri", None, None, None, None),
        ],
        graph.schema,
    )
    for fn in (textio.with_parsed_line, textio.with_parsed_tsv):
        line = textio.ntriples_line if fn is textio.with_parsed_line else textio.tsv_line
        df = tricky.select(*[F.col(c).alias("o_" + c) for c in graph.columns], line().alias("l"))
        back = fn(df, "l")
        for c in ("sub", "pred", "obj", "kind", "dt", "lang", "num"):
            got = [(r["o_" + c], r[c]) for r in back.collect()]
            assert all(a == b for a, b in got), (c, got)


def test_parse_ntriples_lines(spark):
    lines = spark.createDataFrame(
        [
            ("<http://example.org/shop/instances/p/1> <http://www.w3.org/2000/01/rdf-schema#label> \"a . b\"@EN .",),
            ("# a comment",),
            ("",),
            ("_:b1 <http://xmlns.com/foaf/0.1/name> \"7\"^^<http://www.w3.org/2001/XMLSchema#integer> .",),
        ],
        "line string",
    )
    out = textio.parse_ntriples(lines)
    assert rows(out, "sub", "pred", "obj", "lang", "dt", "num") == [
        ("_:b1", "foaf:name", "7", None, "xsd:integer", 7.0),
        ("p/1", "rdfs:label", "a . b", "en", None, None),
    ]


def test_file_round_trip(spark, graph, tmp_path):
    textio.write_ntriples(graph, str(tmp_path / "nt"), parts=2)
    back = textio.read_ntriples(spark, str(tmp_path / "nt"))
    assert rows(back, "sub", "pred", "obj", "kind") == rows(graph, "sub", "pred", "obj", "kind")
    textio.write_tsv(graph, str(tmp_path / "tsv"))
    back = textio.read_tsv(spark, str(tmp_path / "tsv"))
    assert rows(back, "sub", "pred", "obj", "kind") == rows(graph, "sub", "pred", "obj", "kind")


def test_expand_shorten_and_clean(spark):
    df = spark.createDataFrame([("rdfs:label",), ("product/3",), ("http://x.org/y",)], "p string")
    out = df.select("p", T.expand(F.col("p")).alias("f")).select("p", "f", T.shorten(F.col("f")).alias("s"))
    got = {r.p: (r.f, r.s) for r in out.collect()}
    assert got["rdfs:label"] == ("http://www.w3.org/2000/01/rdf-schema#label", "rdfs:label")
    assert got["product/3"] == ("http://example.org/shop/instances/product/3", "product/3")
    assert got["http://x.org/y"] == ("http://x.org/y", "http://x.org/y")
    # no truncation: long predicates keep their whole name
    long = "http://example.org/a/very/long/predicate/name/that/goes/on#andOn"
    c = spark.createDataFrame([(long,)], "p string").select(T.clean_iri(F.col("p"))).first()[0]
    assert c == "http_example_org_a_very_long_predicate_name_that_goes_on_andOn"


def test_lang_matches(spark):
    df = spark.createDataFrame([("en",), ("EN-us",), ("de",), (None,)], "l string")
    got = df.select(T.lang_matches(F.col("l"), "en").alias("m"), T.lang_matches(F.col("l"), "*").alias("a")).collect()
    assert [(r.m, r.a) for r in got] == [(True, True), (True, True), (False, True), (False, False)]


def test_cast_term(spark):
    df = spark.createDataFrame([("12.5",), ("x",)], "v string")
    got = [r[0] for r in df.select(T.cast_term(F.col("v"), "xsd:double")).collect()]
    assert got == [12.5, None]


def test_a_line_is_taken_apart_once(spark):
    text = 'a "quoted"\\ text\twith \\u0041\n' * 30
    data = [(f"s/{k}", "p:t", t, "lit", dt, lang, None, None) for k, (t, dt, lang) in enumerate([(text, None, "en"), (text, "xsd:string", None), ("\u0001 \\u00e9", "xsd:string", None), ("", "xsd:string", None), ("7", "xsd:integer", None)])]
    lines = textio.format_ntriples(spark.createDataFrame(data + [("s/9", "p:o", "o/1", "iri", None, None, None, None)], T.TRIPLE_SCHEMA))
    odd = spark.createDataFrame([(x,) for x in ("no triple", '<a:s> <a:p> "open .', "<a:s><a:p>_:b.# note", '<a:s> <a:p> "x"@en-GB . # note', '<a:s> <a:p> "caf\\u00e9\\\\n\\U0001F600" .', "", "  # note")], "line string")
    read = textio.parse_ntriples(lines.unionByName(odd))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"^\s*(<[^<>\s]*>|_:[^\s<>]+)\s*(<[^<>\s]*>)\s*, 0") == 1
    got = {(r["sub"], r["obj"], r["kind"], r["dt"], r["lang"]) for r in read.collect()}
    assert {(d[0], *d[2:6]) for d in data} | {("s/9", "o/1", "iri", None, None), ("a:s", "_:b", "bnode", None, None), ("a:s", "x", "lit", None, "en-gb"), ("a:s", "caf\u00e9\\n\U0001f600", "lit", "xsd:string", None)} == got
    assert sorted(r[0] for r in textio.malformed(odd).collect()) == ['<a:s> <a:p> "open .', "no triple"]
