import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spogrid.functions.terms import TRIPLE_SCHEMA  # noqa: E402
from spogrid.session import get_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4)
    yield s


def _row(s, p, o, kind=None, dt=None, lang=None, num=None, ts=None):
    if kind is None:
        kind = "lit" if (dt or lang or num is not None) else "iri"
    if kind == "lit" and dt is None and lang is None:
        dt = "xsd:string"
    return (s, p, o, kind, dt, lang, num, ts)


@pytest.fixture()
def graph(spark):
    """A tiny hand-made graph: two products, a producer, a review, classes."""
    rows = [
        _row("product/1", "rdf:type", "shop:Product"),
        _row("product/1", "rdfs:label", "red gear", kind="lit"),
        _row("product/1", "shop:producer", "producer/1"),
        _row("product/1", "dc:publisher", "producer/1"),
        _row("product/1", "shop:num", "7", dt="xsd:integer", num=7.0),
        _row("product/2", "rdf:type", "shop:Product"),
        _row("product/2", "rdfs:label", "blue gear", kind="lit"),
        _row("product/2", "shop:producer", "producer/1"),
        _row("product/2", "dc:publisher", "producer/9"),
        _row("product/2", "shop:num", "3", dt="xsd:integer", num=3.0),
        _row("producer/1", "rdfs:label", "Acme", kind="lit"),
        _row("review/1", "shop:reviewFor", "product/1"),
        _row("review/1", "rev:text", "Great", lang="en"),
        _row("node/x", "shop:self", "node/x"),
        _row("type/A", "rdfs:subClassOf", "type/B"),
        _row("type/B", "rdfs:subClassOf", "type/C"),
        _row("type/C", "rdfs:subClassOf", "type/A"),
    ]
    return spark.createDataFrame(rows, TRIPLE_SCHEMA)


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
