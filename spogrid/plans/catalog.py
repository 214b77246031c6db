"""Registry of named queries: key -> (spark, sf_dir) -> DataFrame, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spogrid.plans import bi, explore, graph_io, relational, runlog, storage, time_q, units
from spogrid.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def on_triples(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables.get(spark, sf_dir).store)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def on_tables(fn: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables.get(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for i in range(1, 13):
        q[f"explore{i}"] = on_triples(getattr(explore, f"explore{i}"))
    for i in range(1, 9):
        q[f"bi{i}"] = on_triples(getattr(bi, f"bi{i}"))
    for k in STORAGE_KEYS:
        q[k] = on_tables(getattr(storage, k))
    for k in UNIT_KEYS:
        q[k] = on_triples(getattr(units, {"describe": "describe_q", "construct": "construct_q"}.get(k, k)))
    for k in ("interval_lookup", "ordered_diff"):
        q[k] = on_tables(getattr(units, k))
    for k in TIME_KEYS:
        q[k] = on_tables(getattr(time_q, k))
    for k in ("ntriples_parse", "tsv_read"):
        q[k] = on_tables(getattr(graph_io, k))
    for k in ("triplify", "literal_parse", "typed_objects", "ntriples_format", "property_table", "property_bridge"):
        q[k] = on_triples(getattr(graph_io, k))
    q["sql_views"] = on_triples(graph_io.sql_views)
    q["insert_data"] = on_triples(graph_io.insert_data_q)
    q["delete_where"] = on_triples(graph_io.delete_where_q)
    q["quads_provenance"] = on_tables(graph_io.quads_provenance)
    q["insert_graph"] = on_tables(graph_io.insert_graph_q)
    q["delete_graph"] = on_tables(graph_io.delete_graph_q)
    for k in ("run_metrics", "mix_metrics", "merge_metrics", "steady_state", "metrics_pivot", "window_28d",
              "mix_lookup"):
        q[k] = on_tables(getattr(runlog, k))
    for i in range(1, 13):
        q[f"rel{i}"] = on_tables(getattr(relational, f"rel{i}"))
    from spogrid.plans import stream_q

    q["stream_updates"] = on_tables(stream_q.stream_updates)
    return q


UNIT_KEYS = (
    "tp_predicate tp_subject tp_object tp_var_predicate tp_review tp_blank tp_repeat_var project "
    "filter_compare filter_logic filter_bound filter_regex filter_like filter_var_eq param_query "
    "bgp_star bgp_chain bgp_snowflake group_join join_unbound sequence_join optional optional_filter "
    "optional_nested optional_disjoint semi_join anti_join anti_optional band_join theta_join self_join "
    "right_join scalar_subquery "
    "agg_count agg_avg agg_minmax agg_having agg_nested agg_ratio argmax_group agg_union below_group_avg "
    "distinct word_count union_pad union_distinct result_diff order_by order_expr limit offset_limit topk_sub "
    "path_seq path_alt path_inv path_mix type_closure type_levels type_features describe construct "
    "lang_matches fn_str fn_cast iri_prefix iri_clean fn_arith "
    "path_star path_plus path_opt path_all_pairs path_negated path_between "
    "intersect_set intersect_bag except_set except_bag agg_rollup agg_cube agg_grouping_sets global_rank"
).split()


STORAGE_KEYS = (
    "tt_count predicates vp_sizes related_predicates extvp_ss extvp_os extvp_so extvp_stats extvp_bounded "
    "extvp_summary extvp_storage extvp_rows choose_tables empty_relation bgp_extvp sketch_stats bgp_sketched "
    "catalog_star catalog_chain catalog_layout"
).split()


TIME_KEYS = "asof_join lag_lead window_tumbling window_sliding window_session interval_stream_join".split()


def oracle_sql() -> dict[str, str]:
    from spogrid.plans import bi_sql, explore_sql, storage_sql

    sql: dict[str, str] = {}
    sql.update(explore_sql.SQL)
    sql.update(bi_sql.SQL)
    sql.update(storage_sql.SQL)
    from spogrid.plans import units_sql

    sql.update(units_sql.SQL)
    from spogrid.plans import graph_io_sql

    sql.update(graph_io_sql.SQL)
    from spogrid.plans import relational_sql

    sql.update(relational_sql.SQL)
    from spogrid.plans import direct_sql

    sql.update(direct_sql.SQL)
    sql.update(time_q.SQL)
    sql["catalog_star"], sql["catalog_chain"] = sql["bgp_star"], sql["bgp_chain"]
    return sql
