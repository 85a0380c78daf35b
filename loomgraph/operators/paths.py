"""Breadth-first search, shortest and simple paths, landmark distances, random walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.edges import name, predicate
from loomgraph.names import DISTANCE, DST, FROM, ID, LANDMARK, SRC, TO
from loomgraph.operators.graph import Graph
from loomgraph.plans.fixed_point import not_converged, written_each_round
from loomgraph.plans.store import Store, files_for


def walkable(graph: Graph, edge_filter: Column | str | None = None) -> DataFrame:
    """Distinct (src, dst) steps; the filter sees edges as they are stored, before they are turned."""
    edges = graph.edges if edge_filter is None else graph.edges.where(predicate(edge_filter))
    return graph.orient(edges.select(SRC, DST)).distinct()


def _too_many(max_paths: int) -> ValueError:
    return ValueError(f"more than max_paths={max_paths} paths")


class _Search:
    """Levels of a breadth-first search from many sources: levels[d] holds (id, pred) with every predecessor of a vertex first reached at depth d."""

    def __init__(self, store: Store, steps: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int):
        self.levels: list[DataFrame] = []
        self.depth: int | None = None
        goal = targets.select(ID).distinct().withColumn("goal", F.lit(True))
        visited = frontier = sources.select(ID).distinct()
        for _ in range(max_hops):
            reached = steps.join(frontier.select(F.col(ID).alias(SRC)), SRC).select(F.col(DST).alias(ID), F.col(SRC).alias("pred"))
            fresh = reached.join(visited, ID, "left_anti").join(goal, ID, "left")
            level, seen = store.measured(fresh.select(ID, "pred", "goal"), rows=F.count(F.lit(1)), goals=F.count_if(F.col("goal")))
            if not seen["rows"]:
                return
            self.levels.append(level)
            if seen["goals"]:
                self.depth = len(self.levels)
                return
            frontier = level.select(ID).distinct()
            visited = visited.union(frontier)

    def paths(self, store: Store, max_paths: int) -> DataFrame:
        """[path]: all shortest paths to the nearest targets, from their ends backwards through the levels."""
        last = self.levels[-1].where("goal")
        paths = last.select(ID).distinct().select(F.array(ID).alias("path"))
        for level in reversed(self.levels):
            longer = paths.join(level.select(F.col(ID).alias("head"), "pred"), F.col("path")[0] == F.col("head")).select(F.array_prepend("path", F.col("pred")).alias("path"))
            paths, seen = store.measured(longer, rows=F.count(F.lit(1)))
            if seen["rows"] > max_paths:
                raise _too_many(max_paths)
        return paths


def _one(graph: Graph, vertex: int) -> DataFrame:
    return graph.edges.sparkSession.createDataFrame([(int(vertex),)], f"{ID} bigint")


def bfs(graph: Graph, source: int, target: int, *, max_path_length: int = 10, edge_filter: Column | str | None = None) -> list[int] | None:
    """One shortest path, or None. Of several, the one whose predecessors, walking back from the target, are least."""
    if source == target:
        return [source]
    store = Store(graph.edges.sparkSession)
    search = _Search(store, store.keep(walkable(graph, edge_filter)), _one(graph, source), _one(graph, target), max_path_length)
    if search.depth is None:
        return None
    path = [target]
    for level in reversed(search.levels):
        path.append(level.where(F.col(ID) == path[-1]).agg(F.min("pred")).first()[0])
    return path[::-1]


def all_shortest_paths_frame(graph: Graph, source: int, target: int, *, max_path_length: int = 10, edge_filter: Column | str | None = None, max_paths: int = 1_000_000) -> DataFrame:
    """[path array<bigint>]: every shortest path; more than max_paths is a ValueError."""
    if source == target:
        return _one(graph, source).select(F.array(ID).alias("path"))
    store = Store(graph.edges.sparkSession)
    search = _Search(store, store.keep(walkable(graph, edge_filter)), _one(graph, source), _one(graph, target), max_path_length)
    if search.depth is None:
        return graph.edges.sparkSession.createDataFrame([], "path array<bigint>")
    return search.paths(store, max_paths)


def all_shortest_paths(graph: Graph, source: int, target: int, *, max_path_length: int = 10, edge_filter: Column | str | None = None, max_paths: int = 1_000_000) -> list[list[int]]:
    """Every shortest path, sorted; empty if there is none."""
    found = all_shortest_paths_frame(graph, source, target, max_path_length=max_path_length, edge_filter=edge_filter, max_paths=max_paths)
    return sorted(list(r["path"]) for r in found.collect())


def bfs_paths(graph: Graph, from_filter: Column | str, to_filter: Column | str, *, max_path_length: int = 10, edge_filter: Column | str | None = None, max_paths: int = 1_000_000) -> DataFrame:
    """All shortest paths from a set of vertices to the nearest of another, as structs: from, e0, v1, e1, ..., to.

    Vertices in both sets are paths of length 0, with the columns from and to alone. The search runs in Spark; parallel
    edges multiply rows. Without a path the frame is empty, with the columns from and to.
    """
    sources, targets = graph.vertices.where(predicate(from_filter)), graph.vertices.where(predicate(to_filter))
    whole = F.struct(*map(name, graph.vertices.columns))
    both = sources.join(targets.select(ID).distinct(), ID, "left_semi")
    trivial = both.select(whole.alias(FROM), whole.alias(TO))
    if not both.isEmpty():
        return trivial
    store = Store(graph.edges.sparkSession)
    search = _Search(store, store.keep(walkable(graph, edge_filter)), sources, targets, max_path_length)
    if search.depth is None:
        return trivial
    stored = graph.edges if edge_filter is None else graph.edges.where(predicate(edge_filter))
    hop = F.struct(*map(name, stored.columns))
    hops = stored.select(F.col(SRC).alias("tail"), F.col(DST).alias("head"), hop.alias("hop"))
    if not graph.is_directed:
        hops = hops.union(hops.where("tail <> head").select(F.col("head"), F.col("tail"), "hop"))
    depth = search.depth
    rows = search.paths(store, max_paths).select(*[F.col("path")[i].alias(f"__{i}") for i in range(depth + 1)])
    points = graph.vertices.select(F.col(ID).alias("at"), whole.alias("vertex"))
    names = [FROM, *[f"v{i}" for i in range(1, depth)], TO]
    for i in range(depth):
        rows = rows.join(hops.select(F.col("tail").alias(f"__{i}"), F.col("head").alias(f"__{i + 1}"), F.col("hop").alias(f"e{i}")), [f"__{i}", f"__{i + 1}"])
    for i, n in enumerate(names):
        rows = rows.join(points.select(F.col("at").alias(f"__{i}"), F.col("vertex").alias(n)), f"__{i}", "left")
    return rows.select(*[c for i in range(depth) for c in (name(names[i]), F.col(f"e{i}"))], TO)


def shortest_paths(graph: Graph, landmarks: Sequence[int], *, max_iters: int = 100, materialize_every: int = 1, checkpoint_dir: str | None = None) -> DataFrame:
    """[id, landmark, distance]: hops from each vertex to each landmark that it reaches; one search serves all landmarks.

    A landmark that is no vertex has no rows, and one given twice has its rows twice. The state is one table of least
    distances: a round adds the neighbours of the vertices that the round before has reached, keeps the least, and
    writes it once; materialize_every can only be 1.
    """
    written_each_round(materialize_every)
    spark = graph.edges.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in landmarks], f"{LANDMARK} bigint")
    ids = graph.vertices.select(F.col(ID)).distinct()
    start = ids.join(wanted.select(F.col(LANDMARK).alias(ID)).distinct(), ID, "left_semi").select(ID, F.col(ID).alias(LANDMARK), F.lit(0).cast("bigint").alias(DISTANCE))
    back = walkable(graph).join(ids.select(F.col(ID).alias(SRC)), SRC, "left_semi").join(ids.select(F.col(ID).alias(DST)), DST, "left_semi")
    with Store(spark, checkpoint_dir) as store:
        back = store.resident(back.select(SRC, DST), DST)
        state, seen = store.measured(start, 1, rows=F.count(F.lit(1)), new=F.count(F.lit(1)))
        for k in range(1, max_iters + 1):
            if not seen["new"]:
                break
            fresh = back.meets(state.where(F.col(DISTANCE) == k - 1).select(F.col(ID).alias(DST), LANDMARK)).select(F.col(SRC).alias(ID), LANDMARK, F.lit(k).cast("bigint").alias(DISTANCE))
            least = state.union(fresh).groupBy(ID, LANDMARK).agg(F.min(DISTANCE).alias(DISTANCE))
            state, seen = store.measured(least, files_for(8 * seen["rows"]), rows=F.count(F.lit(1)), new=F.count_if(F.col(DISTANCE) == k))
        if seen["new"]:
            not_converged(max_iters)
    return state.join(F.broadcast(wanted), LANDMARK).select(ID, LANDMARK, DISTANCE)


def all_paths_frame(graph: Graph, source: int, target: int, *, max_path_length: int = 5, edge_filter: Column | str | None = None, max_paths: int = 1_000_000) -> DataFrame:
    """[path array<bigint>]: every simple path of at most max_path_length edges."""
    spark = graph.edges.sparkSession
    start = _one(graph, source).select(F.array(ID).alias("path"))
    if source == target:
        return start
    store = Store(spark)
    steps = store.keep(walkable(graph, edge_filter))
    open_, done, rows = start, spark.createDataFrame([], "path array<bigint>"), 1
    for _ in range(max_path_length):
        if rows > max_paths:
            raise _too_many(max_paths)
        longer = open_.join(steps, F.element_at("path", -1) == F.col(SRC)).where(~F.array_contains("path", F.col(DST)))
        grown, seen = store.measured(longer.select(F.array_append("path", F.col(DST)).alias("path"), (F.col(DST) == target).alias("there")), rows=F.count_if(~F.col("there")))
        done = done.union(grown.where("there").select("path"))
        open_, rows = grown.where("not there").select("path"), seen["rows"]
        if not rows:
            break
    return done


def all_paths(graph: Graph, source: int, target: int, *, max_path_length: int = 5, edge_filter: Column | str | None = None, max_paths: int = 1_000_000) -> list[list[int]]:
    """Every simple path of at most max_path_length edges, sorted."""
    found = all_paths_frame(graph, source, target, max_path_length=max_path_length, edge_filter=edge_filter, max_paths=max_paths)
    return sorted(list(r["path"]) for r in found.collect())


def _draw(*key: Column) -> Column:
    """A number below 2**52 from the key."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[k.cast("string") for k in key]).cast("binary")), 1, 13), 16, 10).cast("bigint")


def random_walks_frame(graph: Graph, *, walk_length: int = 10, num_walks: int = 1, seed: int = 0) -> DataFrame:
    """[start, walk, path]: num_walks walks from every vertex, all a step at a time.

    A step's choice is the MD5 of `seed-start-walk-step` (its first 13 hexadecimal digits) modulo the neighbours in
    order, so walks are the same on any cluster and however rows are partitioned. They are not the sequence that one sequential generator would give.
    """
    store = Store(graph.edges.sparkSession)
    order = Window.partitionBy(SRC).orderBy(DST)
    steps = store.keep(walkable(graph).withColumn("place", F.row_number().over(order) - 1))
    fans = steps.groupBy(SRC).agg(F.count(F.lit(1)).alias("fan"))
    numbers = F.array(*[F.lit(k) for k in range(num_walks)]).cast("array<int>")
    walks = graph.vertices.select(F.col(ID).alias("start")).distinct().select("start", F.explode(numbers).alias("walk"))
    walks = walks.select("start", "walk", F.col("start").alias("at"), F.array("start").alias("path"))
    for k in range(walk_length):
        chosen = walks.join(fans.withColumnRenamed(SRC, "at"), "at", "left").withColumn("place", (_draw(F.lit(seed), F.col("start"), F.col("walk"), F.lit(k)) % F.col("fan")).cast("int"))
        moved = chosen.join(steps.select(F.col(SRC).alias("at"), "place", DST), ["at", "place"], "left")
        # A walk that is stuck stays where it is, without a fan, and does not grow.
        walks = store.keep(moved.select("start", "walk", F.coalesce(DST, "at").alias("at"), F.when(F.col(DST).isNull(), F.col("path")).otherwise(F.array_append("path", F.col(DST))).alias("path")))
    return walks.select("start", "walk", "path")


def random_walks(graph: Graph, *, walk_length: int = 10, num_walks: int = 1, seed: int = 0) -> list[list[int]]:
    """The walks as lists, by start and number."""
    rows = random_walks_frame(graph, walk_length=walk_length, num_walks=num_walks, seed=seed).collect()
    return [list(r["path"]) for r in sorted(rows, key=lambda r: (r["start"], r["walk"]))]
