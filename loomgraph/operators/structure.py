"""Vertex measures of the simple undirected graph: core numbers, triangles, an independent set; and neighbourhood sizes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.edges import canonicalize, dedupe_edges, drop_self_loops, symmetrize
from loomgraph.names import APPROX, CORE, DST, HOP, ID, SELECTED, SRC, TRIANGLES
from loomgraph.operators.graph import Graph, endpoints
from loomgraph.plans import store as tables
from loomgraph.plans.fixed_point import not_converged, written_each_round
from loomgraph.plans.store import Store, files_for

#: A round of k_core by joins looks at the neighbours of changed vertices only if these are fewer than one in so many.
SPARSE = 20
#: Links of a block of vertices, which a task of k_core holds in arrays, and vertices up to which it does so.
BLOCK = 1_000_000
DENSE = 20_000_000


def _pairs(graph: Graph, store: Store) -> tuple[DataFrame, int]:
    """(distinct unordered pairs, loops among them, as a table; how many). So edges are made once, whatever is read from them."""
    up = F.col(SRC) <= F.col(DST)
    low, high = F.when(up, F.col(SRC)).otherwise(F.col(DST)), F.when(up, F.col(DST)).otherwise(F.col(SRC))
    pairs, seen = store.measured(dedupe_edges(graph.edges.select(low.alias(SRC), high.alias(DST))), rows=F.count(F.lit(1)))
    return pairs, seen["rows"]


def _every(graph: Graph, pairs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """`found` [id, column] of the vertices that have a link, and zero for the others."""
    zero = F.lit(0).cast("bigint")
    if graph.derived:
        alone = pairs.where(~F.coalesce(F.col(SRC) != F.col(DST), F.lit(False)))
        return found.union(endpoints(alone).distinct().join(found, ID, "left_anti").select(ID, zero))
    return graph.vertices.select(F.col(ID)).distinct().join(found, ID, "left").select(ID, F.coalesce(column, zero).alias(column))


def k_core(graph: Graph, *, max_iters: int = 100, materialize_every: int = 1, checkpoint_dir: str | None = None) -> DataFrame:
    """[id, core]: core numbers, as the fixed point of each vertex taking the h-index of its neighbours' estimates.

    Up to DENSE vertices of at most HUB neighbours each, blocks of them keep their links in arrays: in a round a task
    brings its block to rest while the others' estimates stand, and these are one array that every round broadcasts.
    Beyond that rounds are joins. A round needs to know what changed in the one before, so materialize_every can only be 1.
    """
    written_each_round(materialize_every)
    with Store(graph.vertices.sparkSession, checkpoint_dir) as store:
        pairs, rows = _pairs(graph, store)
        links = symmetrize(drop_self_loops(pairs))
        degrees = links.groupBy(F.col(SRC).alias(ID)).agg(F.count(F.lit(1)).alias(CORE))
        blocks = max(1, -(-2 * rows // BLOCK))
        # Blocks of neighbouring ids, which often are linked.
        ranged = degrees.repartitionByRange(blocks, ID).withColumn("block", F.spark_partition_id())
        ranged, seen = store.measured(ranged, rows=F.count(F.lit(1)), most=F.max(CORE))
        if seen["rows"] <= DENSE and (seen["most"] or 0) <= tables.HUB:
            found = _blocked_cores(pairs, ranged, seen["rows"], blocks, store, max_iters)
        else:
            found = _joined_cores(links, ranged.select(ID, CORE), store, max_iters)
        return _every(graph, pairs, found, CORE)


def _packed(table: pd.DataFrame) -> pd.DataFrame:
    """A block's links as one row: its first vertex, and the numbers of neighbours and the neighbours of all in order."""
    at, to = table["at"].to_numpy(), table["to"].to_numpy()
    first = at.min()
    counts = np.bincount(at - first).astype(np.int32)
    return pd.DataFrame({"first": [first], "counts": [counts.tobytes()], "to": [to[np.argsort(at, kind="stable")].tobytes()]})


def _settled(first: int, counts: np.ndarray, to: np.ndarray, estimates: np.ndarray) -> np.ndarray:
    """A block's estimates when each is at most the h-index of its neighbours', the others' being as they are."""
    estimates = estimates.copy()
    own = estimates[first : first + len(counts)]
    starts = np.cumsum(counts) - counts
    while True:
        enough = estimates[to] >= np.repeat(own, counts)
        looked = np.flatnonzero(np.add.reduceat(enough, starts, dtype=np.int64) < own)
        if not len(looked):
            return own
        n = counts[looked]
        begin = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(begin, n)
        heard = estimates[to[np.repeat(starts[looked], n) + within]]
        heard = heard[np.lexsort((-heard, np.repeat(np.arange(len(n)), n)))]
        own[looked] = np.maximum.reduceat(np.minimum(heard, within + 1), begin)


def _blocked_cores(pairs: DataFrame, ranged: DataFrame, rows: int, blocks: int, store: Store, max_iters: int) -> DataFrame:
    """[id, core] of the vertices [id, core (their degrees), block], which are numbered in the order of their blocks."""
    spark = pairs.sparkSession
    held = {r["block"]: r["count"] for r in ranged.groupBy("block").count().collect()}
    if not held:
        return ranged.select(ID, CORE)
    offsets = spark.createDataFrame([(b, sum(n for a, n in held.items() if a < b)) for b in held], "block int, offset int")
    place = (F.row_number().over(Window.partitionBy("block").orderBy(ID)) - 1 + F.col("offset")).cast("int")
    numbered = store.keep(ranged.join(F.broadcast(offsets), "block").select(ID, "block", place.alias("place"), F.col(CORE).cast("int").alias(CORE)))
    ends = drop_self_loops(pairs)
    for end in (SRC, DST):
        ends = ends.join(numbered.select(F.col(ID).alias(end), F.struct("block", "place").alias(f"{end}_at")), end).drop(end)
    one = lambda end, other: F.struct(F.col(f"{end}_at.block").alias("block"), F.col(f"{end}_at.place").alias("at"), F.col(f"{other}_at.place").alias("to"))
    both = ends.select(F.explode(F.array(one(SRC, DST), one(DST, SRC))).alias("link")).select("link.*").repartition(blocks, "block")
    packed = store.keep(both.groupBy("block").applyInPandas(_packed, "first int, counts binary, to binary"))
    estimates = np.zeros(rows, np.int32)
    for r in packed.select("first", "counts").toLocalIterator():
        counts = np.frombuffer(r["counts"], np.int32)
        estimates[r["first"] : r["first"] + len(counts)] = counts
    for _ in range(max_iters):
        known = spark.sparkContext.broadcast(estimates)

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, counts, to in zip(*batch.columns):
                    first, counts, to = first.as_py(), np.frombuffer(counts.as_buffer(), np.int32), np.frombuffer(to.as_buffer(), np.int32)
                    after = _settled(first, counts, to, known.value)
                    less = np.flatnonzero(after < known.value[first : first + len(counts)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([(less + first).astype(np.int32).tobytes()], pa.binary()), pa.array([after[less].tobytes()], pa.binary())], ["at", "core"])

        changes = packed.mapInArrow(settle, "at binary, core binary").where("length(at) > 0").collect()
        known.destroy()
        if not changes:
            break
        for r in changes:
            estimates[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["core"], np.int32)
        if len(held) == 1:  # nothing outside that could change
            break
    else:
        not_converged(max_iters)
    known = spark.sparkContext.broadcast(estimates)
    core = F.pandas_udf(lambda at: pd.Series(known.value[at.to_numpy()].astype(np.int64)), "bigint")
    return store.keep(numbered.select(ID, core("place").alias(CORE)))


def _joined_cores(links: DataFrame, degrees: DataFrame, store: Store, max_iters: int) -> DataFrame:
    """[id, core] of the vertices that have a link, from their degrees.

    The h-index comes from counts of neighbours per estimate, so no vertex's neighbours are gathered into one array. Once
    few estimates change, a round looks only at the neighbours of those that did.
    """
    down = Window.partitionBy(ID).orderBy(F.desc("estimate"))
    links = store.resident(links, SRC)
    state, seen = store.measured(degrees.select(ID, CORE, F.lit(True).alias("less")), rows=F.count(F.lit(1)), less=F.count(F.lit(1)))
    for _ in range(max_iters):
        if not seen["less"]:
            break
        estimates = links.meets(state.select(F.col(ID).alias(SRC), F.col(CORE).alias("estimate")))
        if SPARSE * seen["less"] < seen["rows"]:
            near = links.meets(state.where("less").select(F.col(ID).alias(SRC))).select(DST).distinct()
            estimates = estimates.join(near, DST, "left_semi")
        heard = estimates.groupBy(F.col(DST).alias(ID), "estimate").agg(F.count(F.lit(1)).alias("n"))
        index = heard.select(ID, F.least("estimate", F.sum("n").over(down)).alias("h")).groupBy(ID).agg(F.max("h").alias("h"))
        core = F.least(CORE, F.coalesce("h", CORE))
        after = state.join(index, ID, "left").select(ID, core.alias(CORE), (core < F.col(CORE)).alias("less"))
        state, seen = store.measured(after, files_for(seen["rows"]), rows=F.count(F.lit(1)), less=F.count_if(F.col("less")))
    if seen["less"]:
        not_converged(max_iters)
    return state.select(ID, CORE)


def triangle_count(graph: Graph) -> DataFrame:
    """[id, triangle_count] of every vertex.

    Edges point from the end of smaller degree (then id) to the other, so that even a hub has few outgoing edges, at most
    the root of twice the edges. What comes after b in the list of a, and the list of b, have the third corners of the
    triangles over an edge from a to b: a row for each edge is shuffled, and not one for each pair of edges out of a vertex.
    """
    store = Store(graph.edges.sparkSession)
    pairs, _ = _pairs(graph, store)
    simple = drop_self_loops(pairs)
    degrees = store.keep(endpoints(simple).groupBy(ID).agg(F.count(F.lit(1)).alias("d")))
    ranked = simple
    for end in (SRC, DST):
        ranked = ranked.join(degrees.select(F.col(ID).alias(end), F.struct("d", ID).alias(f"{end}_rank")), end)
    low, high = F.least("src_rank", "dst_rank"), F.greatest("src_rank", "dst_rank")
    out = ranked.select(low[ID].alias("a"), high.alias("b")).groupBy("a").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b[ID]).alias("out"))
    out = store.keep(out)
    later = out.select("a", "out", F.posexplode("out").alias("place", "b")).select("a", "b", F.slice("out", F.col("place") + 2, F.size("out")).alias("later")).where(F.size("later") > 0)
    # By merging: the size of a file of lists says little about their size in memory, by which a broadcast would have to be chosen.
    closed = later.join(out.select(F.col("a").alias("b"), "out").hint("merge"), "b").select("a", "b", F.array_intersect("later", "out").alias("c")).where(F.size("c") > 0)
    one = lambda corner, n: F.struct(corner.alias(ID), n.cast("bigint").alias("n"))
    ends = F.array(one(F.col("a"), F.size("c")), one(F.col("b"), F.size("c")))
    corners = closed.select(F.explode(F.concat(ends, F.transform("c", lambda c: one(c, F.lit(1))))).alias("corner")).select("corner.*")
    found = corners.groupBy(ID).agg(F.sum("n").alias(TRIANGLES))
    if graph.derived:
        found = degrees.join(found, ID, "left").select(ID, F.coalesce(TRIANGLES, F.lit(0).cast("bigint")).alias(TRIANGLES))
    return _every(graph, pairs, found, TRIANGLES)


def maximal_independent_set(graph: Graph, *, max_iters: int = 1000) -> DataFrame:
    """[id, selected]: the independent set that takes vertices in the order of their ids.

    In each round the vertices below all their undecided neighbours join, and their neighbours drop out. At the cap,
    which warns, what is undecided is not selected.
    """
    store = Store(graph.vertices.sparkSession)
    ids = graph.vertices.select(F.col(ID)).distinct()
    links, seen = store.measured(symmetrize(canonicalize(graph.edges)), rows=F.count(F.lit(1)))
    out: DataFrame | None = None  # vertices that lost to a neighbour
    for _ in range(max_iters):
        if not seen["rows"]:
            break
        least = links.groupBy(F.col(SRC).alias(ID)).agg(F.min(DST).alias("least"))
        winners = least.where(F.col(ID) < F.col("least")).select(ID)
        losers = store.keep(links.join(winners.withColumnRenamed(ID, SRC), SRC, "left_semi").select(F.col(DST).alias(ID)).distinct())
        out = losers if out is None else out.union(losers)
        for end in (SRC, DST):
            links = links.join(losers.withColumnRenamed(ID, end), end, "left_anti")
        # Winners' edges went with their losers.
        links, seen = store.measured(links.select(SRC, DST), rows=F.count(F.lit(1)))
    if seen["rows"]:
        not_converged(max_iters)
        out = endpoints(links).distinct() if out is None else out.union(endpoints(links).distinct())
    if out is None:
        return ids.select(ID, F.lit(True).alias(SELECTED))
    return ids.join(out.distinct().withColumn("lost", F.lit(True)), ID, "left").select(ID, F.col("lost").isNull().alias(SELECTED))


#: Bits of a vertex's hash: the first 13 hexadecimal digits of the MD5 of its id as text.
HASH_BITS = 52


def _register(vertex: Column, precision: int) -> tuple[Column, Column]:
    """(register, rank of the first one bit) of a vertex's hash."""
    h = F.conv(F.substring(F.md5(vertex.cast("string").cast("binary")), 1, 13), 16, 10).cast("bigint")
    rest = HASH_BITS - precision
    low = h.bitwiseAND((1 << rest) - 1)
    length = F.when(low == 0, 0).otherwise(F.length(F.bin(low)))
    return F.shiftright(h, rest).cast("int"), (rest - length + 1).cast("int")


#: Registers to a row of a sketch.
PACK = 32


def _estimate(precision: int, registers: list[str]) -> Column:
    """From a vertex's rows of registers, null where empty."""
    m = 1 << precision
    #: HyperLogLog's bias correction.
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    filled = F.sum(sum(F.col(r).isNotNull().cast("int") for r in registers))
    empty = F.lit(m) - filled
    raw = F.lit(alpha * m * m) / (F.sum(sum(F.coalesce(F.pow(F.lit(2.0), -F.col(r)), F.lit(0.0)) for r in registers)) + empty)
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(F.lit(float(m)) / F.greatest(empty, F.lit(1)))).otherwise(raw)


def hyper_anf(graph: Graph, *, max_hops: int = 10, precision: int = 10) -> DataFrame:
    """[id, hop, approx_count]: about how many vertices each reaches within 0 to max_hops hops.

    A sketch is a few rows of PACK registers each, of which those without a filled register are not there: a hop is a
    join and a maximum of PACK columns that partial aggregation and spilling serve, and moves a row where registers as
    rows of their own would move PACK. When no register changes any more, later hops repeat the last one.
    """
    if not 4 <= precision <= 18:
        raise ValueError(f"precision must be in [4, 18], got {precision}")
    each = min(PACK, 1 << precision)
    registers = [f"r{k}" for k in range(each)]
    register, rho = _register(F.col(ID), precision)
    ids = graph.vertices.select(F.col(ID)).distinct()
    first = ids.select(ID, register.alias("register"), rho.cast("tinyint").alias("rho"))
    first = first.select(ID, F.floor(F.col("register") / each).cast("int").alias("part"), *[F.when(F.col("register") % each == k, F.col("rho")).alias(r) for k, r in enumerate(registers)])
    filled = {"filled": F.sum(sum(F.coalesce(F.col(r).cast("bigint"), F.lit(0)) for r in registers)), "rows": F.count(F.lit(1))}
    parts = []

    def shot(hop: int) -> DataFrame:
        return now.groupBy(ID).agg(_estimate(precision, registers).alias(APPROX)).select(ID, F.lit(hop).cast("bigint").alias(HOP), APPROX)

    with Store(graph.vertices.sparkSession) as store:
        steps = graph.orient(graph.edges.select(SRC, DST)).distinct().join(ids.select(F.col(ID).alias(SRC)), SRC, "left_semi")
        steps = store.resident(steps.select(SRC, DST), DST)
        now, seen = store.measured(first, **filled)
        parts.append(shot(0))
        for hop in range(1, max_hops + 1):
            heard = steps.meets(now.withColumnRenamed(ID, DST)).select(F.col(SRC).alias(ID), "part", *registers)
            merged = now.union(heard).groupBy(ID, "part").agg(*[F.max(r).alias(r) for r in registers])
            before = seen
            # Registers only grow, so their sum tells whether any did.
            now, seen = store.measured(merged, **filled)
            parts.append(shot(hop))
            if seen == before:
                parts += [shot(later) for later in range(hop + 1, max_hops + 1)]
                break
    return reduce(DataFrame.union, parts)
