"""Measures of a graph with the size and the skew of a real one, against plain Python."""

import heapq
import random

import pytest

import loomgraph as lg
from tests.helpers import adjacency, directed, hops, pagerank, pairs_of, undirected, weak

NODES, LINKS = 7_000, 100_000


@pytest.fixture(scope="module")
def links():
    """Targets by preferential attachment: in-degrees fall off as a power, the first vertices are hubs."""
    r, ends, out = random.Random(42), list(range(20)), set()
    while len(out) < LINKS:
        a, b = r.randrange(NODES), r.choice(ends) if r.random() < 0.8 else r.randrange(NODES)
        if a != b and (a, b) not in out:
            out.add((a, b))
            ends.append(b)
    return sorted(out)


def test_skew(links):
    indegree = adjacency([(b, a) for a, b in links])
    assert max(map(len, indegree.values())) > 1000


def test_weak_components(spark, links):
    want = weak(links[:9_000], range(NODES))
    for strategy in ("distributed", "local"):
        g = undirected(spark, links[:9_000], range(NODES))
        assert dict(pairs_of(lg.connected_components(g, strategy=strategy), "id", "component")) == want


def test_strong_components(spark, links):
    g = directed(spark, links, range(NODES))
    far, near = (pairs_of(lg.strongly_connected_components(g, strategy=s), "id", "component") for s in ("distributed", "local"))
    adj, back = adjacency(links), adjacency([(b, a) for a, b in links])
    largest = max({c for _, c in near}, key=lambda c: sum(x == c for _, x in near))
    assert far == near and {v for v, c in near if c == largest} == hops(adj, largest).keys() & hops(back, largest).keys()


def test_ranks(spark, links):
    got, want = dict(pairs_of(lg.pagerank(directed(spark, links, range(NODES)), tol=1e-12), "id", "rank")), pagerank(links, range(NODES), rounds=60)
    assert all(abs(got[v] - want[v]) < 1e-8 for v in want)


def test_cores(spark, links):
    adj = adjacency(links, both=True)
    heap, core, k = [(len(n), v) for v, n in adj.items()], dict.fromkeys(range(NODES), 0), 0
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v not in adj or d != len(adj[v]):
            continue
        k = max(k, d)
        core[v] = k
        for w in adj.pop(v):
            adj[w].discard(v)
            heapq.heappush(heap, (len(adj[w]), w))
    assert dict(pairs_of(lg.k_core(undirected(spark, links, range(NODES))), "id", "core")) == core


def test_distances(spark, links):
    back = adjacency([(b, a) for a, b in links])
    got = pairs_of(lg.shortest_paths(directed(spark, links, range(NODES)), [3, 6_500]), "id", "landmark", "distance")
    assert got == {(v, w, d) for w in (3, 6_500) for v, d in hops(back, w).items()} | {(6_500, 6_500, 0)}


def test_a_path_brings_few_rows_to_the_driver(spark, links, monkeypatch):
    pulled = []
    frame = type(spark.range(1))
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: pulled.append(rows := plain(self)) or rows)
    adj = adjacency(links)
    far = max(hops(adj, 100).items(), key=lambda x: (x[1], -x[0]))
    path = lg.bfs(directed(spark, links), 100, far[0])
    assert len(path) == far[1] + 1 and all(b in adj[a] for a, b in zip(path, path[1:]))
    assert sum(map(len, pulled)) <= 20
