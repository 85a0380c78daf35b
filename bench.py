"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

Beside the seconds it has each query's Spark jobs and the tables that its loops wrote, about one a round.
"""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomgraph as lg
from loomgraph.plans.store import Store
from loomgraph.queries import QUERIES

HEADLINE = ("degrees", "canonicalize", "aggregate_messages", "connected_components", "connected_components_chain", "connected_components_local", "strongly_connected_components", "pagerank", "shortest_paths", "label_propagation", "k_core", "triangle_count", "maximal_independent_set", "hyper_anf", "find_one_way", "reindex_mapping")
RANDOM_EDGES = 1_000_000


def random_edges(spark: SparkSession, edges: int = RANDOM_EDGES, seed: int = 0) -> DataFrame:
    """Uniform random edges over a fifth as many vertices."""
    nodes = max(2, edges // 5)
    end = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(nodes))
    return spark.range(edges).select(end(1).alias("src"), end(2).alias("dst"))


def main() -> None:
    warnings.simplefilter("ignore")
    cpus, sf_dir = int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = {name: (lambda f=QUERIES[name]: f(spark, sf_dir)) for name in HEADLINE}
    work["components_of_1m_random_edges"] = lambda: lg.connected_components(lg.UndirectedGraph(random_edges(spark)), strategy="distributed")
    work["degrees"]().count()  # starts the session
    took: dict[str, float] = {}
    jobs: dict[str, int] = {}
    tables: dict[str, int] = {}
    for name, f in work.items():
        spark.sparkContext.setJobGroup(name, name)
        begun, before = time.perf_counter(), Store.tables
        f().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 2)
        jobs[name], tables[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), Store.tables - before
        print(f"{name}: {took[name]} s, {jobs[name]} jobs, {tables[name]} tables", file=sys.stderr)
    print(json.dumps({"metric": "seconds for all headline graph queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "jobs": jobs, "tables": tables, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
