"""Communities: label propagation and power iteration clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.edges import canonicalize, symmetrize
from loomgraph.names import CLUSTER, DST, ID, LABEL, SRC
from loomgraph.operators.graph import Graph, endpoints
from loomgraph.plans.fixed_point import not_converged
from loomgraph.plans.store import Store, files_for


def label_propagation(graph: Graph, *, max_iters: int = 10, materialize_every: int = 1, checkpoint_dir: str | None = None) -> DataFrame:
    """[id, label]: each round every vertex takes the label that most of its neighbours have, the least of equals.

    Parallel edges vote once each, and a self-loop votes twice. A vertex that hears nothing keeps its label.
    """
    with Store(graph.vertices.sparkSession, checkpoint_dir) as store:
        edges, seen = store.measured(graph.edges.select(SRC, DST), rows=F.count(F.lit(1)))
        ids = endpoints(edges) if graph.derived else graph.vertices.select(F.col(ID))
        state = ids.distinct().select(ID, F.col(ID).alias(LABEL))
        if not seen["rows"]:
            return state
        # Votes by neighbour: parallel edges are counted once and for all.
        votes = store.resident(symmetrize(edges).groupBy(SRC, DST).agg(F.count(F.lit(1)).alias("votes")), SRC)
        files = None
        for k in range(1, max_iters + 1):
            heard = votes.meets(state.select(F.col(ID).alias(SRC), LABEL)).groupBy(F.col(DST).alias(ID), LABEL).agg(F.sum("votes").alias("votes"))
            chosen = heard.groupBy(ID).agg(F.max_by(LABEL, F.struct("votes", -F.col(LABEL))).alias("heard"))
            after = state.join(chosen, ID, "left").select(ID, F.coalesce("heard", LABEL).alias(LABEL), (F.coalesce("heard", LABEL) != F.col(LABEL)).alias("new"))
            if k % materialize_every and k < max_iters:
                state = after.select(ID, LABEL)
                continue
            after, seen = store.measured(after, files, new=F.count_if(F.col("new")), rows=F.count(F.lit(1)))
            state, files = after.select(ID, LABEL), files_for(seen["rows"])
            if not seen["new"]:
                break
        else:
            not_converged(max_iters)
    return state


def starting_places(distinct: int, k: int) -> list[int]:
    """Which of the distinct values, in order, are the first centres."""
    # Clusters depend on where k-means starts.
    return [round(i * (distinct - 1) / (k - 1)) for i in range(k)]


def cluster_numbers(values: list[tuple[float, int]], k: int, rounds: int) -> list[float]:
    """Borders of a one-dimensional k-means over (value, count) pairs in order: a value's cluster is how many borders it passes.

    A value midway between two centres goes to the first; an empty cluster keeps its centre. No more distinct values than
    k are clusters of their own.
    """
    points, weights = (np.array(x) for x in zip(*values)) if values else (np.zeros(0), np.zeros(0))
    middle = lambda x: (x[1:] + x[:-1]) / 2
    if len(points) <= max(k, 1) or k <= 1:
        return middle(points).tolist() if k > 1 else []
    centres, borders, cuts = points[starting_places(len(points), k)], np.zeros(0), None
    for _ in range(rounds):
        after = middle(centres)
        at = np.searchsorted(points, after, side="right").tolist()
        if at == cuts:
            break
        borders, cuts = after, at
        for c, (low, high) in enumerate(zip([0, *at], [*at, len(points)])):
            if low < high:
                centres[c] = np.average(points[low:high], weights=weights[low:high])
    return borders.tolist()


def _passed(borders: list[float]) -> Column:
    """The cluster of `value`: how many borders it passes."""
    cluster = F.lit(0)
    for b in borders:
        cluster = cluster + (F.col("value") > b).cast("int")
    return cluster


def distributed_cluster_numbers(distinct: DataFrame, rows: int, k: int, rounds: int, store: Store) -> list[float]:
    """cluster_numbers() of a table of `rows` distinct (value, n), more than k: a sum and a count per centre and round.

    Ranks are places within ranges of values, after the rows of the ranges before. The assignment stands when the
    clusters, which are intervals, have as many distinct values as before.
    """
    if k <= 1:
        return []
    dealt = store.keep(distinct.repartitionByRange(files_for(rows), "value").withColumn("range", F.spark_partition_id()))
    wanted, start = [], 0
    places = starting_places(rows, k)
    for part in sorted(dealt.groupBy("range").count().collect(), key=lambda r: r["range"]):
        wanted += [(part["range"], p - start + 1, p) for p in sorted(set(places)) if start <= p < start + part["count"]]
        start += part["count"]
    local = dealt.where(F.col("range").isin(sorted({r for r, _, _ in wanted}))).withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("value")))
    found = local.join(F.broadcast(dealt.sparkSession.createDataFrame(wanted, "range int, place int, at long")), ["range", "place"]).collect()
    at = {r["at"]: r["value"] for r in found}
    centres = [at[p] for p in places]
    borders: list[float] = []
    held: dict[int, int] = {}
    for _ in range(rounds):
        after = [(x + y) / 2 for x, y in zip(centres, centres[1:])]
        sums = dealt.groupBy(_passed(after).alias("c")).agg(F.sum(F.col("value") * F.col("n")).alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("held")).collect()
        if {r["c"]: r["held"] for r in sums} == held:
            break
        borders, held = after, {r["c"]: r["held"] for r in sums}
        for r in sums:
            centres[r["c"]] = r["s"] / r["n"]
    return borders


def power_iteration_clustering(graph: Graph, k: int, *, max_iters: int = 100, tol: float = 1e-5, kmeans_iters: int = 50, bins: int = 100_000) -> DataFrame:
    """[id, cluster] of the vertices with edges, by k-means on a slowly converging power iteration.

    The vector starts at the degrees and stops when its change hardly changes. Values are rounded to 12 significant
    digits. All distinct ones are clustered with their counts: by the driver up to `bins` of them, beyond that by the
    same rule in aggregations.
    """
    if k < 1:
        raise ValueError(f"k must be >= 1, got {k}")
    spark = graph.edges.sparkSession
    both = symmetrize(canonicalize(graph.edges))
    degrees = both.groupBy(SRC).agg(F.count(F.lit(1)).alias("degree"))
    with Store(spark) as store:
        links = store.resident(both, DST)
        state, seen = store.measured(degrees.select(F.col(SRC).alias(ID), "degree", F.col("degree").cast("double").alias("x"), F.lit(0.0).alias("moved"), F.lit(0.0).alias("bend")), total=F.sum("x"), rows=F.count(F.lit(1)))
        if not seen["rows"]:
            return spark.createDataFrame([], f"{ID} bigint, {CLUSTER} bigint")
        scale, files = seen["total"], files_for(seen["rows"])
        for step in range(max_iters):
            # x is kept before its division by `scale`, which is known only when the round is written.
            x = F.col("x") / F.lit(float(scale))
            sums = links.meets(state.select(F.col(ID).alias(DST), x.alias("value"))).groupBy(F.col(SRC).alias(ID)).agg(F.sum("value").alias("heard"))
            after = state.join(sums, ID).select(ID, "degree", x.alias("before"), F.col("moved"), (F.col("heard") / F.col("degree")).alias("x"))
            after, seen = store.measured(after, files, total=F.sum(F.abs("x")))
            scale = seen["total"] or 1.0
            moved = F.col("x") / F.lit(float(scale)) - F.col("before")
            state, seen = store.measured(after.select(ID, "degree", "x", moved.alias("moved"), F.abs(moved - F.col("moved")).alias("bend")), files, bend=F.sum("bend"))
            if step and seen["bend"] < tol:
                break
    # By way of decimal digits, so that sums in another order give the same value on both sides of a power of ten.
    values = store.keep(state.select(ID, F.format_string("%.11e", F.col("x") / F.lit(float(scale))).cast("double").alias("value")))
    distinct = store.keep(values.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    rows = distinct.count()
    if rows > max(bins, k):
        borders = distributed_cluster_numbers(distinct, rows, k, kmeans_iters, store)
    else:
        borders = cluster_numbers(sorted((r["value"], r["n"]) for r in distinct.collect()), k, kmeans_iters)
    return values.select(ID, _passed(borders).cast("bigint").alias(CLUSTER))
