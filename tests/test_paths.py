import pytest

import loomgraph as lg
from tests.helpers import adjacency, directed, edges, hops, pairs_of, random_digraph, simple_paths, undirected

DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3)]


def test_bfs(spark):
    g = directed(spark, DIAMOND)
    assert lg.bfs(g, 0, 3) == [0, 1, 3] and lg.bfs(g, 3, 0) is None and lg.bfs(g, 99, 99) == [99]
    assert lg.bfs(g, 0, 3, max_path_length=1) is None
    assert lg.bfs(directed(spark, [(0, 5), (0, 2), (5, 9), (2, 9)]), 0, 9) == [0, 2, 9]
    assert lg.bfs(undirected(spark, DIAMOND), 3, 0) == [3, 1, 0]


def test_filters_come_before_turning(spark):
    e = edges(spark, [(0, 1, "a"), (1, 2, "b"), (0, 2, "a")], ["type string"])
    assert lg.bfs(lg.UndirectedGraph(e), 1, 2, edge_filter="type = 'a'") == [1, 0, 2]
    e = edges(spark, [(0, 1, "a"), (1, 2, "a"), (0, 2, "b")], ["type string"])
    assert lg.bfs(lg.DirectedGraph(e), 0, 2) == [0, 2] and lg.bfs(lg.DirectedGraph(e), 0, 2, edge_filter="type = 'a'") == [0, 1, 2]


def test_all_shortest_paths(spark):
    g = directed(spark, DIAMOND)
    assert lg.all_shortest_paths(g, 0, 3) == [[0, 1, 3], [0, 2, 3]]
    assert lg.all_shortest_paths(g, 3, 0) == [] and lg.all_shortest_paths(g, 5, 5) == [[5]]
    with pytest.raises(ValueError, match="max_paths"):
        lg.all_shortest_paths(g, 0, 3, max_paths=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    e = random_digraph(seed, 9, 20)
    g = directed(spark, e)
    far = hops(adjacency(e), 0)
    target = max(far, key=lambda v: (far[v], v))
    want = [p for p in simple_paths(e, 0, target, far[target]) if len(p) == far[target] + 1]
    assert lg.all_shortest_paths(g, 0, target) == want
    assert lg.all_paths(g, 0, target, max_path_length=4) == simple_paths(e, 0, target, 4)
    back = adjacency([(b, a) for a, b in e])
    rows = {(v, m, d) for m in (0, 3) for v, d in hops(back, m).items()}
    assert pairs_of(lg.shortest_paths(g, [0, 3, 99]), "id", "landmark", "distance") == rows


def test_shortest_paths_edge_cases(spark):
    g = directed(spark, [], [0, 1, 2])
    assert pairs_of(lg.shortest_paths(g, [1, 99]), "id", "landmark", "distance") == {(1, 1, 0)}
    g = directed(spark, [(0, 1), (1, 2), (2, 3)])
    assert [(r.id, r.distance) for r in lg.shortest_paths(g, [3]).orderBy("id").collect()] == [(0, 3), (1, 2), (2, 1), (3, 0)]
    assert lg.shortest_paths(g, [3, 3]).count() == 8
    with pytest.warns(UserWarning):
        assert lg.shortest_paths(g, [3], max_iters=1).count() == 2


def test_all_paths_cap(spark):
    e = [(0, k) for k in range(1, 9)] + [(k, 9) for k in range(1, 9)]
    with pytest.raises(ValueError, match="max_paths"):
        lg.all_paths(directed(spark, e), 0, 9, max_paths=3)
    assert lg.all_paths(directed(spark, e), 4, 4) == [[4]]


def test_bfs_paths(spark):
    v = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "id long, name string")
    g = lg.DirectedGraph(edges(spark, [(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d"), (0, 1, "z")], ["type string"]), v)
    found = g.bfs_paths("id = 0", "id in (2, 4)")
    assert found.columns == ["from", "e0", "v1", "e1", "to"]
    rows = {(r["from"].name, r.e0.type, r.v1.id, r.e1.type, r.to.name) for r in found.collect()}
    assert rows == {("n0", "a", 1, "b", "n2"), ("n0", "z", 1, "b", "n2")}
    assert g.bfs_paths("id in (0, 1)", "id in (0, 2)").columns == ["from", "to"] and g.bfs_paths("id in (0, 1)", "id in (0, 2)").count() == 1
    assert g.bfs_paths("id = 4", "id = 0").count() == 0 and g.bfs_paths("id = 77", "id = 0").columns == ["from", "to"]
    with pytest.raises(ValueError, match="max_paths"):
        directed(spark, DIAMOND).bfs_paths("id = 0", "id = 3", max_paths=1)
    both = g.as_undirected().bfs_paths("id = 4", "id = 2")
    assert [(r["from"].id, r.e0.src, r.e0.dst, r.to.id) for r in both.collect()] == [(4, 3, 4, 2)]


def test_random_walks(spark):
    e = random_digraph(4, 8, 14)
    g = directed(spark, e, range(9))
    walks = lg.random_walks(g, walk_length=6, num_walks=3, seed=5)
    adj = adjacency(e)
    assert len(walks) == 27 and walks == lg.random_walks(g, walk_length=6, num_walks=3, seed=5)
    for w in walks:
        assert all(b in adj[a] for a, b in zip(w, w[1:])) and (len(w) == 7 or not adj.get(w[-1]))
    assert walks != lg.random_walks(g, walk_length=6, num_walks=3, seed=6) and lg.random_walks(g, num_walks=0) == []
