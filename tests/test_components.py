import random

import pytest
from pyspark.sql import functions as F

import loomgraph as lg
from loomgraph.operators import components
from loomgraph.plans.store import Store
from tests.helpers import directed, edges, pairs_of, random_digraph, strong, undirected, weak


@pytest.mark.parametrize("strategy", ["distributed", "local", "auto"])
@pytest.mark.parametrize("nodes,n,seed", [(5, 8, 1), (30, 20, 5)])
def test_weak_components_of_random_graphs(spark, strategy, nodes, n, seed):
    r = random.Random(seed)
    e = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(n)]
    g = undirected(spark, e, range(nodes))
    assert dict(pairs_of(lg.connected_components(g, strategy=strategy), "id", "component")) == weak(e, range(nodes))


@pytest.mark.parametrize("strategy", ["distributed", "local"])
def test_long_path_and_dangling_ends(spark, strategy):
    e = [(k + 1, k) for k in range(60)]
    assert set(dict(pairs_of(lg.connected_components(undirected(spark, e), strategy=strategy), "id", "component")).values()) == {0}
    # Connected through a vertex outside the table, which has no row of its own.
    g = directed(spark, [(1, 50), (50, 2)], [1, 2, 7])
    assert pairs_of(lg.connected_components(g, strategy=strategy), "id", "component") == {(1, 1), (2, 1), (7, 7)}


def test_star_steps(spark):
    assert pairs_of(lg.large_star(edges(spark, [(1, 2), (2, 3)])), "src", "dst") == {(2, 1), (3, 1)}
    assert pairs_of(lg.small_star(edges(spark, [(1, 2), (1, 3), (2, 3)])), "src", "dst") == {(2, 1), (3, 1), (3, 2)}


@pytest.mark.parametrize("strategy", ["distributed", "local"])
@pytest.mark.parametrize("seed,n", [(0, 20), (1, 14), (2, 26)])
def test_strong_components_of_random_graphs(spark, strategy, seed, n):
    e = random_digraph(seed, 12, n)
    g = directed(spark, e, range(14))
    assert dict(pairs_of(lg.strongly_connected_components(g, strategy=strategy), "id", "component")) == strong(e, range(14))


def test_edgeless_and_bad_strategy(spark):
    g = directed(spark, [], [1, 2])
    for f in (lg.connected_components, lg.strongly_connected_components):
        for strategy in ("distributed", "local"):
            assert pairs_of(f(g, strategy=strategy), "id", "component") == {(1, 1), (2, 2)}
        with pytest.raises(ValueError):
            f(g, strategy="other")


def test_cycles(spark):
    g = directed(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (7, 7)])
    assert pairs_of(lg.vertices_on_cycles(g), "id") == {(0,), (1,), (2,), (7,)} and lg.has_cycle(g)
    assert not lg.has_cycle(directed(spark, [(0, 1), (1, 2)]))


def test_reusing_a_folder(spark, tmp_path):
    first = lg.connected_components(undirected(spark, [(1, 2)]), strategy="distributed", checkpoint_dir=str(tmp_path))
    second = lg.connected_components(undirected(spark, [(8, 9), (9, 10)]), strategy="distributed", checkpoint_dir=str(tmp_path))
    assert pairs_of(first, "id", "component") == {(1, 1), (2, 1)}
    assert pairs_of(second, "id", "component") == {(8, 8), (9, 8), (10, 8)}


def test_the_round_cap_does_not_change_labels(spark):
    e = [(k, k + 1) for k in range(40)] + [(50, 60), (60, 55)]
    got = lg.connected_components(undirected(spark, e), strategy="distributed", max_iters=1)
    assert dict(pairs_of(got, "id", "component")) == weak(e, {v for p in e for v in p})


def cycle(n, seed):
    """A cycle whose ids stand in no order."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return [(order[k], order[(k + 1) % n]) for k in range(n)]


@pytest.mark.parametrize("n", [130, 1000])
def test_long_cycles(spark, n):
    g = directed(spark, cycle(n, n) + [(5, 2000), (2000, 2001), (3000, 7), *[(4000 + k, 4001 + k) for k in range(300)]])
    far, near = (dict(pairs_of(lg.strongly_connected_components(g, strategy=s), "id", "component")) for s in ("distributed", "local"))
    assert far == near and [v for v in range(n) if far[v]] == []


def test_chains_between_components(spark):
    """Chains within a component, between two, from a vertex back to it, and chains that only show once others are gone."""
    ring = lambda first, n: [(first + k, first + (k + 1) % n) for k in range(n)]
    e = ring(0, 5) + [(0, 2), (3, 1)] + ring(10, 6) + [(10, 13)] + [(4, 20), (20, 21), (21, 12)]
    e += [(30, 31), (31, 32), (32, 30), (30, 33), (33, 34), (34, 30)]  # two chains at one vertex
    e += [(40, 41), (41, 43), (40, 42), (42, 43), (43, 44), (44, 40)]  # two chains with the same ends
    e += ring(50, 4) + [(60, 50), (53, 61), (61, 62)]
    g = directed(spark, e)
    want = strong(e, {v for p in e for v in p})
    assert dict(pairs_of(lg.strongly_connected_components(g, strategy="distributed"), "id", "component")) == want


def test_too_many_phases_are_an_error(spark):
    e = random_digraph(3, 12, 40)
    with pytest.raises(RuntimeError):
        lg.strongly_connected_components(directed(spark, e), strategy="distributed", max_iters=0)
    with pytest.raises(ValueError, match="materialize_every"):
        lg.strongly_connected_components(directed(spark, e), materialize_every=2)


@pytest.mark.parametrize("strategy", ["local", "auto"])
def test_no_more_edges_than_the_threshold_come_to_the_driver(spark, strategy, monkeypatch):
    """Neither at once nor after contraction, and the labels are the same."""
    brought, arrays = [], components._edge_arrays
    monkeypatch.setattr(components, "_edge_arrays", lambda e: brought.append(e.count()) or arrays(e))
    e = random_digraph(4, 40, 130) + [(9, 9), (70, 71), (72, 71), (72, 73)]
    vertices = {v for p in e for v in p}
    for most in (1, 20, 1000):
        got = lg.connected_components(undirected(spark, e), strategy=strategy, local_threshold=most)
        assert dict(pairs_of(got, "id", "component")) == weak(e, vertices)
        got = lg.strongly_connected_components(directed(spark, e), strategy=strategy, local_threshold=most)
        assert dict(pairs_of(got, "id", "component")) == strong(e, vertices)
        assert all(n <= most for n in brought)
    assert len(brought) > 1


def test_hooking_leaves_few_edges(spark):
    """A dense graph is almost contracted before the star rounds begin."""
    e = edges(spark, random_digraph(1, 60, 1200))
    roots, left, seen = components._hooked(e, Store(spark), rows=F.count(F.lit(1)))
    assert roots.count() == 60 and seen["rows"] == left.count() < 20
