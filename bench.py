"""Benchmark: headline queries at one scale factor; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

Headline set: the star, chain and snowflake BGPs and one with sparse properties over
three storages of the same triples, plus the explore and BI workloads on the per-predicate store.

* ``tt``      -- the whole triple table as one DataFrame (patterns filter it); timed, not in ``value``
* ``vp``      -- per-predicate projections of the source tables (nothing copied)
* ``stored``  -- triples written once as Parquet partitioned by predicate
* ``extvp``   -- stored semi-join reductions chosen by statistics, else stored VP

Every query runs once untimed (plan, codegen, JIT) and once timed; execution
uses the ``noop`` sink so results are computed in full but not collected.
Storage builds are timed separately and not part of ``value``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from spogrid.operators import extvp  # noqa: E402
from spogrid.operators.patterns import bgp  # noqa: E402
from spogrid.plans import bi, explore, storage, units  # noqa: E402
from spogrid.session import checkpoint_dir, get_session  # noqa: E402
from spogrid.sources.store import TripleStore, load_triples, write_triples  # noqa: E402
from spogrid.sources.tables import Tables  # noqa: E402

BOUND = 0.25
SHAPES = {"bgp_star": units.STAR, "bgp_chain": units.CHAIN, "bgp_snowflake": units.SNOWFLAKE, "bgp_selective": storage.CHOICE_BGP}
PROJ = {
    "bgp_selective": ["review", "product", "r4", "label", "t4"],
    "bgp_star": ["offer", "product", "vendor", "price"],
    "bgp_chain": ["review", "region"],
    "bgp_snowflake": ["offer", "pcountry", "vcountry", "type"],
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus)
    work = f"{checkpoint_dir(spark).rstrip('/')}/spogrid-bench/{os.path.basename(sf_dir)}"

    t = Tables.get(spark, sf_dir)
    vp = t.store
    tt = TripleStore.from_table(vp.all)
    builds: dict[str, float] = {}

    builds["store_write"] = timed(lambda: write_triples(vp, f"{work}/vp"))
    stored = load_triples(spark, f"{work}/vp")

    def build_reductions():
        extvp.bounded(extvp.reduction_stats(stored), BOUND).write.mode("overwrite").parquet(f"{work}/stats")
        stats = spark.read.parquet(f"{work}/stats")
        extvp.write_reductions(stored, stats, None, f"{work}/extvp")

    builds["extvp_build"] = timed(build_reductions)
    stats = spark.read.parquet(f"{work}/stats")
    reduced = spark.read.parquet(f"{work}/extvp")

    def extvp_query(pats, cols):
        choice = extvp.choose_tables(spark, pats, stats).collect()  # one row per pattern
        tables = {}
        for r in choice:
            if r["rel"] != "VP":
                red = reduced.where((F.col("rel") == r["rel"]) & (F.col("p1") == r["p1"]) & (F.col("p2") == r["p2"]))
                tables[r["idx"]] = red.select("sub", F.col("p1").alias("pred"), "obj", "kind", "dt", "lang", "num", "ts")
        return bgp(stored, pats, tables=tables).select(*cols)

    plans = {}
    for name, pats in SHAPES.items():
        cols = PROJ[name]
        plans[f"{name}_tt"] = lambda p=pats, c=cols: bgp(tt, p).select(*c)
        plans[f"{name}_vp"] = lambda p=pats, c=cols: bgp(vp, p).select(*c)
        plans[f"{name}_stored"] = lambda p=pats, c=cols: bgp(stored, p).select(*c)
        plans[f"{name}_extvp"] = lambda p=pats, c=cols: extvp_query(p, c)
    for i in range(1, 13):
        plans[f"explore{i}"] = lambda i=i: getattr(explore, f"explore{i}")(vp)
    for i in range(1, 9):
        plans[f"bi{i}"] = lambda i=i: getattr(bi, f"bi{i}")(vp)

    times: dict[str, float] = {}
    for name, make in plans.items():
        run(make())  # warm-up: plan, codegen, JIT
        times[name] = round(timed(lambda m=make: run(m())), 3)

    # patterns over the whole table as one frame are a yardstick and not a way to work
    whole = {k: times.pop(k) for k in list(times) if k.endswith("_tt")}
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "whole_table": whole,
        "builds": {k: round(v, 3) for k, v in builds.items()},
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
