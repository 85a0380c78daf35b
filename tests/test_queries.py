"""Registered queries against their SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from loomgraph.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Loops take a second a round; these are the ones that don't loop, and a loop of each kind.
CHOSEN = (
    "graph_counts", "graph_rename", "graph_vertices", "degrees", "out_degrees", "in_degrees", "degree_by_type", "triplets", "filter_vertices", "filter_edges",
    "drop_isolated_vertices", "reverse", "as_undirected", "as_directed", "to_edges", "drop_self_loops", "dedupe_edges", "canonicalize", "symmetrize",
    "aggregate_messages", "large_star", "small_star", "connected_components_chain", "label_propagation", "triangle_count", "all_paths", "find_one_way",
    "find_path", "find_triangle", "find_disconnected", "reindex", "reindex_mapping", "read_table", "write_table", "read_edge_list", "read_catalog",
    "validated_graph", "is_directed", "svd_plus_plus", "svd_plus_plus_distributed", "random_walks", "hyper_anf",
)


def plain(rows, columns, names):
    order = [columns.index(c) for c in names]
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    assert plain(map(tuple, df.collect()), df.columns, names) == plain(want.fetchall(), want.columns, names)


def test_registry():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) <= set(queries)
