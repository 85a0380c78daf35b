"""PageRank, uniform and personalized, from one source set or many at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.edges import dedupe_edges
from loomgraph.names import DST, ID, RANK, SOURCE, SRC
from loomgraph.operators.graph import DirectedGraph, endpoints
from loomgraph.plans.fixed_point import not_converged, written_each_round
from loomgraph.plans.store import Store, files_for


def _known(vertices: DataFrame, wanted: Sequence[int]) -> set[int]:
    frame = vertices.sparkSession.createDataFrame([(int(i),) for i in set(wanted)], f"{ID} bigint")
    return {r[0] for r in frame.join(vertices, ID, "left_semi").collect()}


#: Walks whose sums are observed while a round is written; those of more walks come from a small aggregation of it.
OBSERVED = 4


def _written(graph: DirectedGraph, store: Store) -> tuple[DataFrame, int, DataFrame, int]:
    """(distinct edges, how many, vertices, how many) as tables, so that both are made once. Ends that are the vertices come from the edges."""
    distinct, seen = store.measured(dedupe_edges(graph.edges), rows=F.count(F.lit(1)))
    ids = endpoints(distinct) if graph.derived else graph.vertices.select(F.col(ID))
    ids, held = store.measured(ids.distinct(), rows=F.count(F.lit(1)))
    return distinct, seen["rows"], ids, held["rows"]


def _power(distinct: DataFrame, derived: bool, walks: dict[int, list[int] | None], damping: float, max_iters: int, tol: float, store: Store, n: int, ids: DataFrame) -> DataFrame:
    """[walk, id, rank] for walks that restart at their seeds (None: anywhere).

    All walks move in one state, and a walk that has converged stays as it is. A round's sums for each walk, the mass on
    vertices without an outgoing edge and the change, are a small table that the next round joins by walk.
    """
    spark = ids.sparkSession
    seeds = spark.createDataFrame([(w, int(i), 1.0 / len(set(s))) for w, s in walks.items() if s is not None for i in set(s)], f"walk int, {ID} bigint, restart double")
    anywhere = [w for w, s in walks.items() if s is None]
    out = store.keep(distinct.groupBy(SRC).agg(F.count(F.lit(1)).alias("out")))
    # Edges to vertices outside the table count for the out-degree, and what they carry is lost.
    inside = distinct
    for end in () if derived else (DST, SRC):
        inside = inside.join(ids.select(F.col(ID).alias(end)), end, "left_semi")
    links = inside.join(out, SRC)
    every = ids.join(F.broadcast(spark.createDataFrame([(w,) for w in walks], "walk int")))
    restart = F.when(F.col("walk").isin(anywhere), F.lit(1.0 / n)).otherwise(F.coalesce("restart", F.lit(0.0))) if anywhere else F.coalesce("restart", F.lit(0.0))
    base = every.join(seeds, ["walk", ID], "left").join(out.select(F.col(SRC).alias(ID), F.lit(False).alias("linked")), ID, "left")
    loose, moved = F.sum(F.when(F.col("sink"), F.col(RANK)).otherwise(0.0)), F.sum("moved")

    def written(state: DataFrame, live: list[int], files: int | None = None) -> tuple[DataFrame, list[tuple[int, float, float]]]:
        """The state as written, and (walk, mass on sinks, change) of each live walk."""
        if len(live) > OBSERVED:
            state = store.keep(state, files)
            return state, [(r["walk"], r["loose"], r["moved"]) for r in state.groupBy("walk").agg(loose.alias("loose"), moved.alias("moved")).collect()]
        own = lambda w, c: F.sum(F.when(F.col("walk") == w, c))
        state, seen = store.measured(state, files, **{f"loose_{w}": own(w, F.when(F.col("sink"), F.col(RANK)).otherwise(0.0)) for w in live}, **{f"moved_{w}": own(w, F.col("moved")) for w in live})
        return state, [(w, seen[f"loose_{w}"], seen[f"moved_{w}"]) for w in live]

    with store:
        links = store.resident(links.select(SRC, DST, "out"), SRC)
        base = store.keep(base.select("walk", ID, restart.alias("restart"), F.col("linked").isNull().alias("sink")))
        live, done = list(walks), []
        state, sums = written(base.select("*", F.lit(1.0 / n).alias(RANK), F.lit(0.0).alias("moved")), live)
        for k in range(max_iters):
            sent = links.meets(state.select("walk", F.col(ID).alias(SRC), RANK)).groupBy("walk", F.col(DST).alias(ID)).agg(F.sum(F.col(RANK) / F.col("out")).alias("heard"))
            # A row for each of the caller's walks.
            totals = F.broadcast(spark.createDataFrame([(w, float(x)) for w, x, _ in sums], "walk int, loose double"))
            rank = damping * (F.coalesce("heard", F.lit(0.0)) + F.col("loose") * F.col("restart")) + (1.0 - damping) * F.col("restart")
            after = state.join(sent, ["walk", ID], "left").join(totals, "walk").select("walk", ID, "restart", "sink", rank.alias("after"), F.col(RANK).alias("before"))
            after = after.select("walk", ID, "restart", "sink", F.col("after").alias(RANK), F.abs(F.col("after") - F.col("before")).alias("moved"))
            state, sums = written(after, live, files_for(n * len(live)))
            over = [w for w, _, x in sums if x < n * tol]
            if k + 1 == max_iters and len(over) < len(live):
                not_converged(max_iters)
                over = live
            if over:
                done.append(state.where(F.col("walk").isin(over)).select("walk", ID, RANK))
                live, sums = [w for w in live if w not in over], [x for x in sums if x[0] not in over]
                if not live:
                    break
                state = state.where(F.col("walk").isin(live))
    if not done:  # no round at all
        not_converged(max_iters)
        done.append(state.select("walk", ID, RANK))
    return reduce(DataFrame.union, done)


def pagerank(graph: DirectedGraph, *, damping: float = 0.85, max_iters: int = 100, tol: float = 1e-6, source_ids: Sequence[int] | None = None, materialize_every: int = 1, checkpoint_dir: str | None = None) -> DataFrame:
    """[id, rank]: ranks sum to one over distinct edges; dangling mass and restarts go to source_ids, or anywhere.

    It ends when the ranks' total change is below tol times the number of vertices. Each round needs sums of the one
    before, so every round is written and materialize_every can only be 1. Sources that are no vertices are
    left out; a ValueError if none is left. Without edges the ranks are the restart distribution.
    """
    written_each_round(materialize_every)
    store = Store(graph.edges.sparkSession, checkpoint_dir)
    distinct, rows, ids, n = _written(graph, store)
    if n == 0:
        return ids.select(ID, F.lit(0.0).alias(RANK))
    seeds = None
    if source_ids is not None:
        seeds = sorted(_known(ids, source_ids)) if source_ids else []
        if not seeds:
            raise ValueError("none of source_ids is a vertex")
    if not rows:
        start = F.lit(1.0 / n) if seeds is None else F.when(F.col(ID).isin(seeds), 1.0 / len(seeds)).otherwise(0.0)
        return ids.select(ID, start.alias(RANK))
    return _power(distinct, graph.derived, {0: seeds}, damping, max_iters, tol, store, n, ids).select(ID, RANK)


def parallel_personalized_pagerank(graph: DirectedGraph, source_ids: Sequence[int], *, damping: float = 0.85, max_iters: int = 100, tol: float = 1e-6, materialize_every: int = 1, checkpoint_dir: str | None = None) -> DataFrame:
    """[id, source, rank]: a personalized ranking for each source, all in one loop. A repeated source repeats its rows."""
    written_each_round(materialize_every)
    wanted = [int(i) for i in source_ids]
    if not wanted:
        raise ValueError("source_ids is empty")
    store = Store(graph.edges.sparkSession, checkpoint_dir)
    distinct, rows, ids, n = _written(graph, store)
    if n == 0:
        return ids.select(ID, F.lit(0).cast("bigint").alias(SOURCE), F.lit(0.0).alias(RANK))
    if missing := sorted(set(wanted) - _known(ids, wanted)):
        raise ValueError(f"{missing} are no vertices")
    walks = dict(enumerate(sorted(set(wanted))))
    if not rows:
        spark = ids.sparkSession
        ranked = ids.join(F.broadcast(spark.createDataFrame(list(walks.items()), f"walk int, {SOURCE} bigint"))).select("walk", ID, (F.col(ID) == F.col(SOURCE)).cast("double").alias(RANK))
    else:
        ranked = _power(distinct, graph.derived, {w: [s] for w, s in walks.items()}, damping, max_iters, tol, store, n, ids)
    places = ids.sparkSession.createDataFrame([(w, s) for w, s in walks.items() for _ in range(wanted.count(s))], f"walk int, {SOURCE} bigint")
    return ranked.join(F.broadcast(places), "walk").select(ID, SOURCE, RANK)
