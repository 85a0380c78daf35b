"""Plain Python answers for small graphs."""

import random
from collections import deque
from itertools import combinations

import loomgraph as lg


def edges(spark, pairs, extra=None):
    if extra:
        names = ", ".join(extra)
        return spark.createDataFrame(pairs, f"src long, dst long, {names}")
    return spark.createDataFrame(pairs, "src long, dst long")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def directed(spark, pairs, vertices=None):
    return lg.DirectedGraph(edges(spark, pairs), None if vertices is None else ids(spark, vertices))


def undirected(spark, pairs, vertices=None):
    return lg.UndirectedGraph(edges(spark, pairs), None if vertices is None else ids(spark, vertices))


def pairs_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def random_digraph(seed, nodes=10, n=20, loops=False):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        a, b = r.randrange(nodes), r.randrange(nodes)
        if loops or a != b:
            out.add((a, b))
    return sorted(out)


def adjacency(pairs, both=False):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
        if both:
            out[b].add(a)
    return out


def hops(adj, start):
    seen, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for w in adj.get(v, ()):
            if w not in seen:
                seen[w] = seen[v] + 1
                todo.append(w)
    return seen


def weak(pairs, vertices):
    adj = adjacency(pairs, both=True)
    return {v: min(hops(adj, v)) for v in vertices}


def strong(pairs, vertices):
    adj = adjacency(pairs)
    reach = {v: set(hops(adj, v)) for v in vertices}
    return {v: min(w for w in reach[v] if v in reach[w]) for v in vertices}


def simple_paths(pairs, a, b, most):
    adj, out = adjacency(pairs), []

    def grow(path):
        if path[-1] == b:
            out.append(path)
        elif len(path) <= most:
            for w in adj.get(path[-1], ()):
                if w not in path:
                    grow([*path, w])

    grow([a])
    return sorted(out)


def triangles(pairs, vertices):
    adj = adjacency([p for p in pairs if p[0] != p[1]], both=True)
    out = dict.fromkeys(vertices, 0)
    for three in combinations(sorted(adj), 3):
        if all(y in adj[x] for x, y in combinations(three, 2)):
            for v in three:
                out[v] += 1
    return out


def cores(pairs, vertices):
    adj = adjacency([p for p in pairs if p[0] != p[1]], both=True)
    out, k = dict.fromkeys(vertices, 0), 0
    while adj:
        v = min(adj, key=lambda x: (len(adj[x]), x))
        k = max(k, len(adj[v]))
        out[v] = k
        for w in adj.pop(v):
            adj[w].discard(v)
    return out


def pagerank(pairs, vertices, damping=0.85, seeds=None, rounds=200):
    n, out = len(vertices), {}
    for a, b in set(pairs):
        out.setdefault(a, []).append(b)
    seeds = [s for s in (seeds or vertices) if s in vertices]
    start = {v: (1 / len(seeds) if v in seeds else 0.0) for v in vertices}
    rank = dict.fromkeys(vertices, 1 / n)
    for _ in range(rounds):
        loose = sum(rank[v] for v in vertices if v not in out)
        after = {v: damping * loose * start[v] + (1 - damping) * start[v] for v in vertices}
        for a, targets in out.items():
            for b in targets:
                if b in after:
                    after[b] += damping * rank[a] / len(targets)
        rank = after
    return rank
