import heapq
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import sharding
from loomgraph.llm.common import Scratch
from loomgraph.llm.sharding import fill, schedule, shard_documents, size_blocks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 60), st.integers(0, 90))
def test_fill_is_the_heap(loads, size, n):
    heap, counts = [(x, i) for i, x in enumerate(loads)], [0] * len(loads)
    heapq.heapify(heap)
    for _ in range(n):
        x, i = heapq.heappop(heap)
        counts[i] += 1
        heapq.heappush(heap, (x + size, i))
    assert fill(loads, size, n) == counts


def plain(sizes, shards):
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


def test_blocks_of_sizes_come_largest_first(spark):
    r = random.Random(2)
    sizes = list({r.randrange(1, 1 << 26): r.choice([1, 1, 2, 40, 700]) for _ in range(3000)}.items())
    df = spark.createDataFrame(sizes, "bytes long, n long")
    blocks = list(size_blocks(df, Scratch(spark, "test"), 250))
    assert len(blocks) > 8 and sorted(x for b in blocks for x in b) == sorted(sizes)
    assert all(min(a)[0] > max(b)[0] for a, b in zip(blocks, blocks[1:]))
    loads = [0] * 24
    for b in blocks:
        schedule(b, loads)
    heap = [(0, i) for i in range(24)]
    for s, n in sorted(sizes, reverse=True):
        for _ in range(n):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + s, i))
    assert loads == [x for x, _ in sorted(heap, key=lambda h: h[1])]


@pytest.mark.parametrize("each", [20_000, 40])
def test_equals_the_plain_heap_at_every_size(spark, each, monkeypatch):
    monkeypatch.setattr(sharding, "SIZES", each)
    sizes = [1 << k for k in range(0, 23)] + [70_000 + 13 * k for k in range(150)] + [5_000] * 30
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").selectExpr("doc_id", "concat(doc_id, repeat('x', n)) as text")
    got = shard_documents(rows, shards=7).groupBy("shard").agg({"size": "sum"}).collect()
    assert sorted(g[1] for g in got) == plain([8 + n + len(str(i)) for i, n in enumerate(sizes)], 7)


def test_equals_the_plain_heap(spark):
    r = random.Random(1)
    rows = [(i, None if i % 40 == 0 else "" if i % 41 == 0 else "é" * r.randrange(300) + str(r.randrange(150))) for i in range(600)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    size = {i: 8 + len((t or "").encode()) for i, t in rows}
    assert {(g.doc_id, g["size"]) for g in got} == set(size.items())
    assert all(g.text_crc32 == zlib.crc32((dict(rows)[g.doc_id] or "").encode()) and g.law == "bytes" and g.grown_shard is None for g in got)
    homes, loads, slots, groups = {}, [0] * 5, {}, {}
    for g in got:
        assert homes.setdefault(dict(rows)[g.doc_id], g.shard) == g.shard
        loads[g.shard] += g["size"]
        slots.setdefault(g.shard, []).append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for i, t in rows:
        groups[t] = groups.get(t, 0) + size[i]
    assert sorted(loads) == plain(groups.values(), 5)


def test_large_groups_and_a_hot_text(spark):
    rows = [(i, "x" * (60_000 + 997 * i)) for i in range(40)] + [(100 + i, "hot" * 50) for i in range(800)] + [(2000 + i, "s" * (i % 700)) for i in range(900)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    loads = [sum(g["size"] for g in got if g.shard == s) for s in range(4)]
    assert len(got) == len(rows) and max(loads) - min(loads) <= 700
    assert len({g.shard for g in got if 100 <= g.doc_id < 900}) == 1


def test_empty_repeated_and_null_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(df).collect() == []
    df = spark.createDataFrame([(1, "a", 3, 1), (1, "a", 3, 1), (None, None, None, 2)], "doc_id long, text string, size int, shard int")
    got = shard_documents(df, shards=2).collect()
    assert sorted((str(g.doc_id), g["size"]) for g in got) == [("1", 9), ("1", 9), ("None", 8)]
