import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from spogrid.plans import catalog
from spogrid.sources.tables import TABLE_NAMES
from tests.conftest import SMOKE
from tools.check import rows_of

# counts over all pairs of predicates, and the update stream: checked by tools/check.py
SLOW = {"extvp_rows", "stream_updates", "insert_graph", "delete_graph", "ntriples_parse", "window_sliding", "window_session", "interval_stream_join"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["product", "label"]
    assert df.count() == 4


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - SLOW))
def test_queries_match_their_oracles(spark, con, key):
    df = catalog.queries()[key](spark, SMOKE)
    cur = con.execute(catalog.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got, want = rows_of(df.columns, df.collect()), rows_of(cols, cur.fetchall())
    assert got == want, (Counter(got) - Counter(want)).most_common(3)


def test_the_rest_works_without_the_optional_part():
    code = """
import sys
sys.modules["spogrid.llm"] = None
import __spark_entry__ as e
assert e.llm_queries is None and "pipeline" not in e.queries() and set(e.queries()) == set(e.oracle_sql())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
