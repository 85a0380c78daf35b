import math
import random
import warnings
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import loomgraph as lg
from loomgraph.operators import community, factor, structure
from loomgraph.plans import store
from tests.helpers import adjacency, cores, directed, edges, hops, pagerank, pairs_of, random_digraph, triangles, undirected

TRIANGLES = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)]


@pytest.mark.parametrize("seeds", [None, [0, 3]])
def test_pagerank(spark, seeds):
    e = random_digraph(3, 10, 22) + [(1, 1)]
    want = pagerank(e, range(12), seeds=seeds)
    got = dict(pairs_of(lg.pagerank(directed(spark, e + e[:4], range(12)), source_ids=seeds, tol=1e-9), "id", "rank"))
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want) and abs(sum(got.values()) - 1) < 1e-9


def test_pagerank_edge_cases(spark):
    assert pairs_of(lg.pagerank(directed(spark, [], [1, 2, 3, 4])), "rank") == {(0.25,)}
    assert lg.pagerank(directed(spark, []), source_ids=[7]).count() == 0
    for bad in ([], [99]):
        with pytest.raises(ValueError):
            lg.pagerank(directed(spark, [(1, 2)]), source_ids=bad)
    with pytest.warns(UserWarning):
        lg.pagerank(directed(spark, [(1, 2), (2, 1), (3, 1)]), max_iters=1, tol=0.0)


def test_parallel_personalized(spark):
    e = random_digraph(6, 8, 16)
    got = lg.parallel_personalized_pagerank(directed(spark, e, range(8)), [2, 5, 2], tol=1e-9).collect()
    assert len(got) == 24
    for s in (2, 5):
        want = pagerank(e, range(8), seeds=[s])
        assert all(abs(r["rank"] - want[r.id]) < 1e-6 for r in got if r.source == s)
    with pytest.raises(ValueError):
        lg.parallel_personalized_pagerank(directed(spark, e), [2, 99])
    with pytest.raises(ValueError):
        lg.parallel_personalized_pagerank(directed(spark, e), [])
    assert pairs_of(lg.parallel_personalized_pagerank(directed(spark, [], [1, 2]), [1]), "id", "source", "rank") == {(1, 1, 1.0), (2, 1, 0.0)}


def test_label_propagation(spark):
    got = dict(pairs_of(lg.label_propagation(undirected(spark, TRIANGLES)), "id", "label"))
    assert len({got[k] for k in (1, 2, 3)}) == len({got[k] for k in (4, 5, 6)}) == 1 and got[1] != got[4]
    assert pairs_of(lg.label_propagation(undirected(spark, [], [3])), "id", "label") == {(3, 3)}


def test_power_iteration_clustering(spark):
    e = [(0, 1), (1, 2), (0, 2), (2, 3)] + [(a, b) for a in range(3, 8) for b in range(a + 1, 8)]
    got = dict(pairs_of(lg.power_iteration_clustering(undirected(spark, e, range(9)), 2), "id", "cluster"))
    assert got.keys() == set(range(8)) and got[0] == got[1] and len({got[k] for k in (4, 5, 6, 7)}) == 1 and got[0] != got[4]
    with pytest.raises(ValueError, match="k must be"):
        lg.power_iteration_clustering(undirected(spark, e), 0)
    assert lg.power_iteration_clustering(undirected(spark, [], [1]), 2).count() == 0


def plain_kmeans(values, k, rounds=50):
    """Clusters of the distinct values, each by its nearest centre."""
    points = sorted(set(values))
    centres = [points[round(i * (len(points) - 1) / (k - 1))] for i in range(k)]
    assigned = None
    for _ in range(rounds):
        after = [min(range(k), key=lambda c: abs(v - centres[c])) for v in values]
        if after == assigned:
            break
        assigned = after
        for c in range(k):
            own = [v for v, a in zip(values, assigned) if a == c]
            centres[c] = sum(own) / len(own) if own else centres[c]
    return assigned


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_clusters_of_many_values(spark, k):
    """Two groups and some hubs far away: steps of the range would put both groups into one."""
    r = random.Random(4)
    values = [r.gauss(1.0, 0.05) * 1e-7 for _ in range(900)] + [r.gauss(2.0, 0.1) * 1e-7 for _ in range(900)] + [r.uniform(1, 90) * 1e-5 for _ in range(40)] + [3e-7] * 20
    counts = Counter(values)
    want = plain_kmeans(values, k) if k > 1 else [0] * len(values)
    community.files_for, old = lambda rows: 7, community.files_for
    try:
        borders = community.distributed_cluster_numbers(spark.createDataFrame(list(counts.items()), "value double, n long"), len(counts), k, 50, community.Store(spark))
    finally:
        community.files_for = old
    assert [sum(v > b for b in borders) for v in values] == want
    local = community.cluster_numbers(sorted(counts.items()), k, 50)
    assert [sum(v > b for b in local) for v in values] == want


def test_clusters_do_not_depend_on_bins(spark):
    r = random.Random(5)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(150)] + [(60 + r.randrange(60), 60 + r.randrange(60)) for _ in range(300)] + [(0, v) for v in range(1, 120)]
    few, many = (pairs_of(lg.power_iteration_clustering(undirected(spark, e), 4, max_iters=4, bins=b), "id", "cluster") for b in (5, 100_000))
    assert few == many and len({c for _, c in many}) == 4


def test_cores_and_triangles(spark):
    e = random_digraph(8, 12, 34) + [(3, 3), (1, 0)]
    g = undirected(spark, e, range(14))
    assert dict(pairs_of(lg.k_core(g), "id", "core")) == cores(e, range(14))
    assert dict(pairs_of(lg.triangle_count(g), "id", "triangle_count")) == triangles(e, range(14))
    empty = undirected(spark, [], [1])
    assert lg.k_core(empty).dtypes == [("id", "bigint"), ("core", "bigint")] and pairs_of(lg.k_core(empty), "id", "core") == {(1, 0)}
    assert pairs_of(lg.triangle_count(empty), "id", "triangle_count") == {(1, 0)}


def test_independent_set(spark):
    e = random_digraph(5, 12, 20)
    adj, taken = adjacency(e, both=True), set()
    for v in range(13):
        if not adj.get(v, set()) & taken:
            taken.add(v)
    assert {r.id for r in lg.maximal_independent_set(undirected(spark, e, range(13))).where("selected").collect()} == taken
    assert pairs_of(lg.maximal_independent_set(undirected(spark, [], [1, 2])), "id", "selected") == {(1, True), (2, True)}
    with pytest.warns(UserWarning):
        lg.maximal_independent_set(undirected(spark, [(k, k + 1) for k in range(9)]), max_iters=1)


def test_hyper_anf(spark):
    e = [(k, (k + 1) % 20) for k in range(20)] + [(0, 10)]
    adj = adjacency(e)
    got = {(r.id, r.hop): r.approx_count for r in lg.hyper_anf(directed(spark, e), max_hops=4).collect()}
    for v in range(20):
        for h in range(5):
            exact = sum(d <= h for d in hops(adj, v).values())
            assert abs(got[v, h] - exact) <= 0.3 * exact + 1.5 and (h == 0 or got[v, h] >= got[v, h - 1])
    for p in (3, 19):
        with pytest.raises(ValueError, match="precision"):
            lg.hyper_anf(directed(spark, e), precision=p)
    assert lg.hyper_anf(directed(spark, [(1, 2)]), max_hops=6, precision=4).count() == 14


def ratings(spark):
    rows = [(u, 1000 + i, 3.0 + math.sin(u * 1.7) * math.cos(i * 0.9) + 0.3 * (u % 3)) for u in range(12) for i in range(9)]
    return lg.DirectedGraph(edges(spark, rows, ["rating double"]))


def test_svd_plus_plus(spark):
    g = ratings(spark)
    few, many = (lg.svd_plus_plus(g, rank=4, epochs=k, learning_rate=0.1) for k in (1, 60))
    assert many.rmse < 0.25 < few.rmse and abs(few.global_mean - 3.3) < 0.5
    assert pairs_of(many.factors, "kind") == {("user",), ("item",)} and many.factors.count() == 21
    assert lg.svd_plus_plus(g, rank=4, epochs=1, learning_rate=0.1).rmse == pytest.approx(few.rmse)


def test_svd_plus_plus_is_the_same_on_both_sides_of_the_threshold(spark):
    g = lg.DirectedGraph(ratings(spark).edges.union(ratings(spark).edges.limit(7)))
    near, far = (lg.svd_plus_plus(g, rank=3, epochs=3, learning_rate=0.05, seed=4, local_threshold=n) for n in (1000, 10))
    assert near.rmse == pytest.approx(far.rmse, abs=1e-12)
    a, b = ({(r.id, r.kind): [r.bias, *r.factor] for r in x.factors.collect()} for x in (near, far))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


@pytest.mark.parametrize("whole,shared", [(1000, 1000), (1000, 0), (60, 10), (0, 0)])
def test_svd_plus_plus_by_components(spark, monkeypatch, whole, shared):
    """Components in tasks of their own, together, or by joins: the same factors. Only larger ones are joined."""
    monkeypatch.setattr(factor, "TASK_RATINGS", whole)
    monkeypatch.setattr(factor, "SHARED_RATINGS", shared)
    joined, joins = [], factor._joined
    monkeypatch.setattr(factor, "_joined", lambda r, *fit: joined.append(r.count()) or joins(r, *fit))
    one = ratings(spark).edges
    few = spark.createDataFrame([(900, 950, 3.0), (900, 951, 4.0), (901, 951, 1.0), (-5, -5, 2.0)], "src long, dst long, rating double")
    g = lg.DirectedGraph(one.union(few).union(one.select(F.col("src") + 1000, F.col("dst") + 1000, "rating")))
    near, far = (lg.svd_plus_plus(g, rank=2, epochs=2, learning_rate=0.05, seed=4, strategy=s) for s in ("local", "distributed"))
    assert near.rmse == pytest.approx(far.rmse, abs=1e-12)
    a, b = ({(r.id, r.kind): [r.bias, *r.factor] for r in x.factors.collect()} for x in (near, far))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert joined == {1000: [], 60: [216], 0: [220]}[whole]


def test_svd_plus_plus_without_ratings(spark):
    got = lg.svd_plus_plus(lg.DirectedGraph(spark.createDataFrame([], "src long, dst long, rating double")))
    assert (got.rmse, got.global_mean, got.factors.count()) == (0.0, 0.0, 0)


def test_hubs_are_split(spark, monkeypatch):
    """Keys of more rows than HUB are dealt to several partitions, and every loop gives what it gives without."""
    monkeypatch.setattr(store, "HUB", 6)
    e = random_digraph(8, 12, 34) + [(0, v) for v in range(3, 30)] + [(v, 0) for v in range(20, 30)]
    g, u = directed(spark, e, range(31)), undirected(spark, e, range(31))
    dealt = store.Store(spark).resident(g.edges, "src")
    assert dealt.hubs is not None and dealt.meets(spark.range(31).toDF("src")).count() == len(e)
    assert dealt.rows.where("src = 0").select("__salt").distinct().count() > 2
    got, want = dict(pairs_of(lg.pagerank(g, tol=1e-9), "id", "rank")), pagerank(e, range(31))
    assert all(abs(got[v] - want[v]) < 1e-6 for v in want)
    assert dict(pairs_of(lg.k_core(u), "id", "core")) == cores(e, range(31))
    adj = adjacency(e)
    assert pairs_of(lg.shortest_paths(g, [0, 5]), "id", "landmark", "distance") == {(v, w, d) for v in range(31) for w, d in hops(adj, v).items() if w in (0, 5)}
    plain = [f() for f in (lambda: lg.label_propagation(u), lambda: lg.hyper_anf(g, max_hops=2, precision=6), lambda: lg.power_iteration_clustering(u, 3))]
    rows = [sorted(map(tuple, df.collect())) for df in plain]
    monkeypatch.setattr(store, "HUB", 10**6)
    again = [f() for f in (lambda: lg.label_propagation(u), lambda: lg.hyper_anf(g, max_hops=2, precision=6), lambda: lg.power_iteration_clustering(u, 3))]
    assert rows == [sorted(map(tuple, df.collect())) for df in again]


def test_many_walks_and_no_rounds(spark):
    e = random_digraph(6, 8, 16)
    got = lg.parallel_personalized_pagerank(directed(spark, e, range(8)), range(7), tol=1e-9).collect()
    for s in range(7):
        want = pagerank(e, range(8), seeds=[s])
        assert all(abs(r["rank"] - want[r.id]) < 1e-6 for r in got if r.source == s)
    with pytest.raises(ValueError, match="materialize_every"):
        lg.pagerank(directed(spark, e), materialize_every=3)


def test_sparse_rounds_of_cores(spark, monkeypatch):
    """A long path loses its estimates from the ends, a vertex at a time."""
    monkeypatch.setattr(structure, "SPARSE", 2)
    e = [(k, k + 1) for k in range(24)] + [(100, 101), (101, 102), (100, 102), (24, 100)]
    assert dict(pairs_of(lg.k_core(undirected(spark, e)), "id", "core")) == cores(e, {v for p in e for v in p})


@pytest.mark.parametrize("block,dense", [(10**6, 10**6), (40, 10**6), (40, 0)])
def test_cores_by_blocks(spark, monkeypatch, block, dense):
    """One block, several, or joins: the same cores. A long path in a block is no matter of rounds."""
    monkeypatch.setattr(structure, "BLOCK", block)
    monkeypatch.setattr(structure, "DENSE", dense)
    e = random_digraph(5, 40, 150, loops=True) + [(100 + k, 101 + k) for k in range(24)] + [(500, 500), (3, 100)]
    before = store.Store.tables
    got = pairs_of(lg.k_core(undirected(spark, e)), "id", "core")
    assert dict(got) == cores(e, {v for p in e for v in p})
    assert dense == 0 or store.Store.tables - before < 10


@pytest.mark.parametrize("measure", [lg.k_core, lg.triangle_count, lg.label_propagation, lg.pagerank])
def test_edges_are_made_once(spark, measure):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    e = edges(spark, random_digraph(8, 12, 34)).mapInArrow(counted, "src long, dst long")
    measure(lg.DirectedGraph(e)).collect()
    assert made.value == 34


def test_a_table_of_one_file_is_not_made_by_one_task(spark):
    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().taskAttemptId()] * batch.num_rows)], ["task"])

    made = spark.range(0, 800, 1, 8).mapInArrow(task, "task long")
    for kept in (store.Store(spark).keep(made, 1), store.Store(spark).measured(made, 1, rows=F.count(F.lit(1)))[0]):
        assert len(kept.inputFiles()) == 1 and kept.distinct().count() == 8 and kept.count() == 800


def test_triangles_of_derived_vertices(spark):
    e = random_digraph(8, 12, 34) + [(3, 3), (1, 0), (50, 50), (60, 61)]
    assert dict(pairs_of(lg.triangle_count(undirected(spark, e)), "id", "triangle_count")) == triangles(e, {v for p in e for v in p})
    odd = lg.triangle_count(undirected(spark, [(1, None), (1, 2)]))
    assert pairs_of(odd, "id", "triangle_count") == {(1, 0), (2, 0), (None, 0)}


def test_messages(spark):
    e = edges(spark, [(0, 1), (1, 2)])
    state = spark.createDataFrame([(0, 10), (1, 20), (2, 30)], "id long, value long")
    both = lg.aggregate_messages(e, state, to_dst=F.col("src_value"), to_src=F.col("dst_value"))
    assert pairs_of(both, "id", "msg") == {(0, 20), (1, 40), (2, 20)}
    assert pairs_of(lg.aggregate_messages(e, state, to_dst=F.col("src_value"), to_src=F.lit(None)), "id", "msg") == {(0, None), (1, 10), (2, 20)}
    with pytest.raises(ValueError):
        lg.aggregate_messages(e, state)
    with pytest.raises(ValueError, match="src_"):
        lg.aggregate_messages(e, state.withColumn("src_x", F.lit(1)), to_dst=F.col("src_value"))


def test_pregel(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3)])
    state = spark.createDataFrame([(k, 9 - k, "t") for k in range(4)], "id long, value long, tag string")
    got = lg.pregel(e, state, update=F.greatest("value", F.coalesce("msg", "value")), to_dst=F.col("src_value"), agg=F.max)
    assert got.columns == ["id", "value", "tag"] and pairs_of(got, "value", "tag") == {(9, "t")}
    with pytest.warns(UserWarning):
        lg.pregel(e, state, update=F.col("value") + 1, to_dst=F.col("src_value"), max_iters=2)
    own = lg.pregel(e, state, update=F.col("value") + 1, to_dst=F.col("src_value"), converged=lambda a, b: True)
    assert pairs_of(own.where("id = 0"), "value") == {(10,)}


def test_fixed_point(spark, tmp_path):
    start = spark.createDataFrame([(5,)], "n int")
    step = lambda s: s.select(F.greatest(F.col("n") - 1, F.lit(0)).alias("n"))
    for options in ({}, {"materialize_every": 2}, {"checkpoint_dir": str(tmp_path)}, {"checkpoint_dir": str(tmp_path)}):
        end, n = lg.iterate_to_fixed_point(start, step, lambda a, b: lg.same_rows(a, b, ["n"]), **options)
        assert (end.first().n, n) == (0, 6)
    for bad in ({"max_iters": 0}, {"materialize_every": 0}):
        with pytest.raises(ValueError):
            lg.iterate_to_fixed_point(start, step, lambda a, b: True, **bad)
    with pytest.warns(UserWarning), warnings.catch_warnings(record=False):
        assert lg.iterate_to_fixed_point(start, step, lambda a, b: False, max_iters=2)[0].first().n == 3


def test_same_rows(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert lg.same_rows(a, a.union(a), ["a", "b"]) and not lg.same_rows(a, a.limit(1), ["a", "b"])
