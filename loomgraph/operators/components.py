"""Weakly and strongly connected components, and cycles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.edges import canonicalize, dedupe_edges, drop_self_loops
from loomgraph.names import COMPONENT, DST, ID, SRC
from loomgraph.operators.graph import DirectedGraph, Graph
from loomgraph.plans.fixed_point import written_each_round
from loomgraph.plans.store import Store, files_for

#: Edges up to which `auto` solves on one machine.
LOCAL_EDGES = 2_000_000


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the least of the vertex and its neighbours."""
    both = edges.union(edges.select(DST, SRC))
    least = both.groupBy(F.col(SRC).alias("hub")).agg(F.min(DST).alias("least")).select("hub", F.least("hub", "least").alias("least"))
    up = both.where(F.col(DST) > F.col(SRC))
    return up.join(least, F.col(SRC) == F.col("hub")).select(F.col(DST).alias(SRC), F.col("least").alias(DST)).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Edges turned to point from the larger to the smaller end: what a small star amounts to on canonical edges."""
    return canonicalize(edges).select(F.col(DST).alias(SRC), F.col(SRC).alias(DST))


def _contract(edges: DataFrame) -> DataFrame:
    """One small-star step by the larger end: it and its smaller neighbours point to the least of those."""
    down = edges.select(F.greatest(SRC, DST).alias("hi"), F.least(SRC, DST).alias("lo"))
    least = down.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = down.join(least, "hi").where("lo <> least").select(F.col("lo").alias(SRC), F.col("least").alias(DST))
    return moved.union(least.select("hi", "least")).distinct()


def _hooked(edges: DataFrame, store: Store, **metrics: Column) -> tuple[DataFrame, DataFrame, dict]:
    """(labels [id, root] of all ends, distinct edges between roots, what is observed of these).

    Every vertex hooks onto its least neighbour if that is less, and pointers jump to their roots. That takes edges three
    times through a shuffle, and in a graph of many edges to a vertex leaves few to the rounds that follow.
    """
    one = lambda end, other: F.struct(F.col(end).alias(ID), F.when(F.col(other) < F.col(end), F.col(other)).otherwise(F.col(end)).alias("root"))
    ends = edges.select(F.explode(F.array(one(SRC, DST), one(DST, SRC))).alias("end")).select("end.*")
    roots, seen = store.measured(ends.groupBy(ID).agg(F.min("root").alias("root")), rows=F.count(F.lit(1)), new=F.count_if(F.col(ID) != F.col("root")))
    while seen["new"]:
        above = roots.select(F.col(ID).alias("root"), F.col("root").alias("above"))
        jumped = roots.join(above, "root", "left").select(ID, F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("new"))
        roots, seen = store.measured(jumped, files_for(seen["rows"]), rows=F.count(F.lit(1)), new=F.count_if(F.col("new")))
        roots = roots.select(ID, "root")
    moved = drop_self_loops(edges)
    for end in (SRC, DST):
        moved = moved.join(roots.select(F.col(ID).alias(end), F.col("root").alias(f"{end}_root")), end)
    left, seen = store.measured(canonicalize(moved.select(F.col("src_root").alias(SRC), F.col("dst_root").alias(DST))), **metrics)
    return roots, left, seen


def _star_labels(edges: DataFrame, store: Store, max_iters: int, materialize_every: int, checkpoint_dir: str | None, most_local: int) -> DataFrame:
    """[id, component] of every end of the edges, which are a written table; at most most_local contracted ones are solved on the driver."""
    metrics = {"rows": F.count(F.lit(1)), "mark": F.bit_xor(F.xxhash64(SRC, DST)), "sum": F.sum(F.xxhash64(DST, SRC).cast("decimal(38,0)"))}
    roots, edges, seen = _hooked(edges, store, **metrics)
    if not seen["rows"]:
        return roots.withColumnRenamed("root", COMPONENT)
    if seen["rows"] <= most_local:
        ids, labels = _weak_arrays(edges)
        stars = _labels_of(edges, ids, labels)
    else:
        stars = _contracted(edges, seen, Store(edges.sparkSession, checkpoint_dir), metrics, max_iters, materialize_every, checkpoint_dir)
    return roots.join(stars.withColumnRenamed(ID, "root"), "root", "left").select(ID, F.coalesce(COMPONENT, "root").alias(COMPONENT))


def _contracted(edges: DataFrame, seen: dict, store: Store, metrics: dict[str, Column], max_iters: int, materialize_every: int, checkpoint_dir: str | None) -> DataFrame:
    """[id, component] of every end of canonical edges, by large-star and small-star."""
    for k in range(1, max_iters + 1):
        if not seen["rows"]:
            break
        after = _contract(large_star(edges))
        if k % materialize_every and k < max_iters:
            edges = after
            continue
        before = seen
        edges, seen = store.measured(after, files_for(seen["rows"]), **metrics)
        if checkpoint_dir is None:
            store.forget()
        if seen == before:
            break
    else:
        return _diffused(edges, store, seen["rows"])
    # Every remaining edge points from a vertex to its component's least vertex.
    return edges.groupBy(F.col(SRC).alias(ID)).agg(F.min(DST).alias(COMPONENT))


def _diffused(edges: DataFrame, store: Store, rows: int) -> DataFrame:
    """[id, component] of edges that are not yet stars: least labels spread until none changes."""
    both = edges.select(SRC, DST).union(edges.select(DST, SRC))
    state = store.keep(both.groupBy(F.col(SRC).alias(ID)).agg(F.least(F.min(DST), F.first(SRC)).alias("value")), files_for(rows))
    return _spread(store, both, state, rows, F.min).withColumnRenamed("value", COMPONENT)


def _labelled(graph: Graph, labels: DataFrame) -> DataFrame:
    """One row per vertex; without a label a vertex is its own component."""
    ids = graph.vertices.select(F.col(ID)).distinct()
    return ids.join(labels, ID, "left").select(ID, F.coalesce(COMPONENT, ID).alias(COMPONENT))


def _edge_arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids of the edges' ends, places of sources, places of targets); the caller has checked the size."""
    pdf = dedupe_edges(edges).toPandas()
    both = np.concatenate([pdf[SRC].to_numpy(), pdf[DST].to_numpy()]) if len(pdf) else np.zeros(0, np.int64)
    ids, places = np.unique(both, return_inverse=True)
    return ids, places[: len(pdf)], places[len(pdf) :]


def _labels_of(edges: DataFrame, ids: np.ndarray, labels: np.ndarray) -> DataFrame:
    return edges.sparkSession.createDataFrame(pd.DataFrame({ID: ids.astype(np.int64), COMPONENT: labels.astype(np.int64)}), f"{ID} bigint, {COMPONENT} bigint")


def _weak_arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, components) of the edges' ends, by hooking and pointer jumping on arrays."""
    ids, a, b = _edge_arrays(edges)
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return ids, ids[root]


def _strong_arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, components) of the edges' ends, by depth-first search with an explicit stack; components close at their roots."""
    ids, a, b = _edge_arrays(edges)
    n = len(ids)
    order = np.argsort(a, kind="stable")
    targets = b[order].tolist()
    first = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    number, low, label = [-1] * n, [0] * n, [-1] * n
    path, clock = [], 0
    for start in range(n):
        if number[start] >= 0:
            continue
        work = [(start, first[start])]
        while work:
            v, k = work.pop()
            if number[v] < 0:
                number[v] = low[v] = clock
                clock += 1
                path.append(v)
            descended = False
            while k < first[v + 1]:
                w = targets[k]
                k += 1
                if number[w] < 0:
                    work += [(v, k), (w, first[w])]
                    descended = True
                    break
                if label[w] < 0:
                    low[v] = min(low[v], number[w])
            if descended:
                continue
            if low[v] == number[v]:
                members = [path.pop()]
                while members[-1] != v:
                    members.append(path.pop())
                least = min(members)
                for m in members:
                    label[m] = least
            if work:
                parent = work[-1][0]
                low[parent] = min(low[parent], low[v])
    return ids, ids[np.array(label, dtype=np.int64)] if n else np.zeros(0, np.int64)


def _inside(graph: Graph) -> DataFrame:
    """Distinct edges without loops; ends outside the vertex table count for nothing."""
    edges = drop_self_loops(dedupe_edges(graph.edges))
    if graph.derived:
        return edges
    for end in (SRC, DST):
        edges = edges.join(graph.vertices.select(F.col(ID).alias(end)), end, "left_semi")
    return edges.select(SRC, DST)


def _most_local(strategy: str, local_threshold: int) -> int:
    """The most edges that are brought to the driver. `local` is no promise to hold more there than it was made for."""
    if strategy not in ("auto", "local", "distributed"):
        raise ValueError(f"strategy must be auto, local or distributed, not {strategy!r}")
    return -1 if strategy == "distributed" else local_threshold


def connected_components(graph: Graph, *, strategy: str = "auto", max_iters: int = 30, materialize_every: int = 1, checkpoint_dir: str | None = None, local_threshold: int = LOCAL_EDGES) -> DataFrame:
    """[id, component]: weak components of either flavor, labelled by their least vertex; one row per vertex.

    `distributed` hooks every vertex onto its least neighbour, then alternates large-star and small-star contraction, each
    round written to the shared folder; after max_iters rounds least labels spread along the edges that are left, until
    they stand. `local` and `auto` bring at most local_threshold edges to the driver: all, if there are no more, else those
    that hooking leaves, if these are no more. The labels are the same.
    """
    most = _most_local(strategy, local_threshold)
    store = Store(graph.edges.sparkSession, checkpoint_dir)
    edges, seen = store.measured(graph.edges.select(SRC, DST), rows=F.count(F.lit(1)))
    if seen["rows"] <= most:
        return _labelled(graph, _labels_of(edges, *_weak_arrays(edges)))
    labels = _star_labels(edges, store, max_iters, materialize_every, checkpoint_dir, most)
    return labels if graph.derived else _labelled(graph, labels)


def strongly_connected_components(graph: DirectedGraph, *, strategy: str = "auto", max_iters: int = 1000, materialize_every: int = 1, checkpoint_dir: str | None = None, local_threshold: int = LOCAL_EDGES) -> DataFrame:
    """[id, component]: strong components labelled by their least vertex; one row per vertex.

    `distributed` repeats three steps until no edge is left. Chains of vertices with one edge in and one out become one
    edge, by pointer jumping, so rounds go with the logarithm of a chain's length. Vertices without an edge in or out go.
    When neither changes anything, colors spread: each vertex takes the greatest id that reaches it; within a color,
    those that reach back to the color's vertex are its component, and go. Every loop runs to its end. Each time colors
    spread, one component at least is found; more than max_iters times is a RuntimeError, never a wrong label.
    `local` and `auto` bring at most local_threshold distinct edges to the driver; more are solved as `distributed`.
    """
    written_each_round(materialize_every)
    most = _most_local(strategy, local_threshold)
    store = Store(graph.edges.sparkSession, checkpoint_dir)
    edges, seen = store.measured(_inside(graph), rows=F.count(F.lit(1)))
    if seen["rows"] <= most:
        return _labelled(graph, _labels_of(edges, *_strong_arrays(edges)))
    return _labelled(graph, _colored(edges, seen["rows"], store, max_iters))


def _spread(store: Store, edges: DataFrame, state: DataFrame, rows: int, best) -> DataFrame:
    """state [id, value]: values move along edges until `best` (F.min or F.max) of the old and the arriving ones changes none."""
    choose = F.least if best is F.min else F.greatest
    while True:
        heard = edges.join(state.select(F.col(ID).alias(SRC), "value"), SRC).groupBy(F.col(DST).alias(ID)).agg(best("value").alias("heard"))
        chosen = choose("value", "heard")
        state, seen = store.measured(state.join(heard, ID, "left").select(ID, chosen.alias("value"), (chosen != F.col("value")).alias("new")), files_for(rows), new=F.count_if(F.col("new")))
        state = state.select(ID, "value")
        if not seen["new"]:
            return state


def _pruned(edges: DataFrame, store: Store, rows: int) -> tuple[DataFrame, int]:
    """Edges between vertices that have edges in and out, after one look."""
    through = edges.select(F.col(SRC).alias(ID)).intersect(edges.select(F.col(DST).alias(ID)))
    kept = edges.join(through.select(F.col(ID).alias(SRC)), SRC, "left_semi").join(through.select(F.col(ID).alias(DST)), DST, "left_semi")
    kept, seen = store.measured(kept.select(SRC, DST), files_for(rows), rows=F.count(F.lit(1)))
    return kept, seen["rows"]


def _unchained(edges: DataFrame, store: Store, rows: int) -> tuple[DataFrame, int, DataFrame, DataFrame] | None:
    """Chains of vertices with one edge in and one out as one edge each; None if there is none.

    (edges, rows, hung [id, head, tail]: the vertices of chains with the chain's ends, rings [id, value]: the vertices of
    cycles that are chains all round, with the cycle's least).
    """
    files = files_for(rows)
    ends = edges.select(F.col(SRC).alias(ID), F.lit(1).alias("out"), F.lit(0).alias("in"), F.col(DST).alias("after")).union(edges.select(DST, F.lit(0), F.lit(1), F.lit(None).cast("bigint")))
    inner = ends.groupBy(ID).agg(F.sum("out").alias("out"), F.sum("in").alias("in"), F.max("after").alias("after")).where("out = 1 and in = 1")
    inner, seen = store.measured(inner.select(ID, "after"), files, rows=F.count(F.lit(1)))
    if not seen["rows"]:
        return None
    # Each points to the next one of its chain, the last one to itself, and knows the least from it up to there.
    nexts = inner.select(F.col(ID).alias("after"), F.lit(True).alias("is_inner"))
    state = inner.join(nexts, "after", "left").select(ID, F.when(F.col("is_inner"), F.col("after")).otherwise(F.col(ID)).alias("to"), F.col(ID).alias("value"), F.col("is_inner").isNull().alias("ended"))
    state, before = store.keep(state, files), None
    while True:
        ahead = state.select(F.col(ID).alias("to"), F.col("to").alias("beyond"), F.col("value").alias("there"), F.col("ended").alias("ends"))
        jumped = state.join(ahead, "to").select(ID, F.col("beyond").alias("to"), F.least("value", "there").alias("value"), F.col("ends").alias("ended"), (F.col("there") < F.col("value")).alias("less"))
        state, seen = store.measured(jumped, files, open=F.count_if(~F.col("ended")), less=F.count_if(F.col("less")))
        # Chains end in every round until all have; of rings, the least is known when no value changes any more.
        if not seen["open"] or seen["open"] == before and not seen["less"]:
            break
        before = seen["open"]
    rings = state.where("not ended").select(ID, "value")
    last = state.where("ended").select(ID, F.col("to").alias("chain"))
    tails = last.where("id = chain").join(inner, ID).select("chain", F.col("after").alias("tail"))
    inside = inner.select(F.col(ID).alias(SRC))
    heads = edges.join(inside, SRC, "left_anti").join(last.select(F.col(ID).alias(DST), "chain"), DST).select("chain", F.col(SRC).alias("head"))
    chains = store.keep(heads.join(tails, "chain"), files)
    hung = store.keep(last.join(chains, "chain").select(ID, "head", "tail"), files)
    plain = edges.join(inside, SRC, "left_anti").join(inside.select(F.col(SRC).alias(DST)), DST, "left_anti").select(SRC, DST)
    short = plain.union(chains.where("head <> tail").select("head", "tail")).distinct()
    short, seen = store.measured(short, files, rows=F.count(F.lit(1)))
    return short, seen["rows"], hung, rings


def _colored(edges: DataFrame, rows: int, store: Store, max_iters: int) -> DataFrame:
    """[id, component] of the vertices in components of two or more; the edges are a written table, distinct and without loops."""
    phases = 0
    found: list[DataFrame] = []
    chains: list[DataFrame] = []
    while rows:
        before = rows
        edges, rows = _pruned(edges, store, rows)
        if rows and (short := _unchained(edges, store, rows)):
            edges, rows, hung, rings = short
            chains.append(hung)
            found.append(rings)
        if rows != before or not rows:
            continue
        phases += 1
        if phases > max_iters:
            raise RuntimeError(f"components are left after colors have spread max_iters={max_iters} times")
        start = edges.select(F.col(SRC).alias(ID)).distinct().select(ID, F.col(ID).alias("value"))
        colors = _spread(store, edges, start, rows, F.max)
        inside = edges.join(colors.select(F.col(ID).alias(SRC), F.col("value").alias("color")), SRC).join(colors.select(F.col(ID).alias(DST), F.col("value").alias("other")), DST).where("color = other").select(SRC, DST)
        inside = store.keep(inside, files_for(rows))
        # Backward from each color's own vertex: 1 where it is reached.
        back = inside.select(F.col(DST).alias(SRC), F.col(SRC).alias(DST))
        reached = _spread(store, back, colors.select(ID, (F.col("value") == F.col(ID)).cast("long").alias("value")), rows, F.max)
        members = store.keep(colors.join(reached.where("value = 1").select(ID), ID, "left_semi"), files_for(rows))
        found.append(members)
        for end in (SRC, DST):
            edges = edges.join(members.select(F.col(ID).alias(end)), end, "left_anti")
        edges, seen = store.measured(edges.select(SRC, DST), files_for(rows), rows=F.count(F.lit(1)))
        rows = seen["rows"]
    labels = edges.sparkSession.createDataFrame([], f"{ID} bigint, value bigint")
    for members in found:
        labels = labels.union(members)
    # A chain belongs to its ends' component if that is one; chains made of chains go first.
    for hung in reversed(chains):
        of = lambda end: labels.select(F.col(ID).alias(end), F.col("value").alias(f"{end}_value"))
        known = hung.join(of("head"), "head", "left").join(of("tail"), "tail", "left")
        one = F.when(F.col("head") == F.col("tail"), F.coalesce("head_value", "head")).when(F.col("head_value") == F.col("tail_value"), F.col("head_value"))
        known = known.select(ID, "head", one.alias("value")).where("value is not null")
        # A vertex that only closes a chain has no component so far: it and the chain are one.
        alone = known.where("head = value").select(F.col("head").alias(ID), "value").distinct().join(labels.select(ID), ID, "left_anti")
        labels = store.keep(labels.union(known.select(ID, "value")).union(alone))
    least = labels.groupBy("value").agg(F.min(ID).alias(COMPONENT))
    return labels.join(least, "value").select(ID, COMPONENT)


def vertices_on_cycles(graph: DirectedGraph, **options) -> DataFrame:
    """[id] of the vertices on a directed cycle: in a component of two or more, or with a self-loop."""
    components = strongly_connected_components(graph, **options)
    several = components.groupBy(COMPONENT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(COMPONENT)
    on = components.join(several, COMPONENT, "left_semi").select(ID)
    return on.union(graph.edges.where(F.col(SRC) == F.col(DST)).select(F.col(SRC).alias(ID))).distinct()


def has_cycle(graph: DirectedGraph, **options) -> bool:
    return not vertices_on_cycles(graph, **options).isEmpty()
