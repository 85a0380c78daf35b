"""Longest-processing-time sharding: groups of equal texts, largest first, each to the least-loaded shard of a heap.

Law `bytes`: shards' sizes are near equal, and equal texts stay together. A document's size is its text's UTF-8 bytes
(null: none) plus 8. Null is a text of its own, apart from the empty text.

The heap runs over sizes, not over groups: the n groups of one size are laid out as a heap would lay them out one by one
(`fill`). Sizes come to the driver in blocks of about SIZES of them, the largest first; only the shards' loads go on from
block to block, and each block's plan is written. Groups are then joined with the plan by their size and rank within it.

Rows that repeat a doc_id are separate rows. An empty table gives no rows. Columns besides id and text are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, blocks_for, column, ranked

#: Sizes that the driver lays out at a time.
SIZES = 20_000


def fill(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each shard gets if each goes to the least-loaded shard, the first of equals.

    Greedy takes the n least of the numbers loads[i] + k * size, so a search for the level replaces n heap steps when
    n is large; the last steps go through the heap.
    """
    counts = [0] * len(loads)
    if n > 4 * len(loads):
        low, high = min(loads), max(loads) + size * n
        while low < high:  # the greatest level below which at most n starts lie
            level = (low + high + 1) // 2
            if sum(max(0, -(-(level - x) // size)) for x in loads) <= n:
                low = level
            else:
                high = level - 1
        counts = [max(0, -(-(low - x) // size)) for x in loads]
    heap = [(x + c * size, i) for i, (x, c) in enumerate(zip(loads, counts))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        x, i = heap[0]
        counts[i] += 1
        heapq.heapreplace(heap, (x + size, i))
    return counts


def schedule(sizes: list[tuple[int, int]], loads: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(size, [(one past the last rank, shard), ...]) for (size, groups) from the largest on; the loads grow along."""
    out = []
    for size, n in sorted(sizes, reverse=True):
        at, ranges = 0, []
        for shard, count in enumerate(fill(loads, size, n)):
            if count:
                at += count
                ranges.append((at, shard))
                loads[shard] += count * size
        out.append((size, ranges))
    return out


def size_blocks(sizes: DataFrame, scratch: Scratch, each: int | None = None) -> Iterator[list[tuple[int, int]]]:
    """The rows (bytes, n) in blocks of about `each`, the largest bytes first."""
    blocks = blocks_for(sizes.count(), each or SIZES)
    dealt = scratch.save(sizes.repartitionByRange(blocks, "bytes").withColumn("block", F.spark_partition_id()), "sizes") if blocks > 1 else sizes.withColumn("block", F.lit(0))
    order = [r["block"] for r in dealt.groupBy("block").agg(F.max("bytes").alias("top")).orderBy(F.desc("top")).collect()]
    for k in order:
        yield [(r["bytes"], r["n"]) for r in dealt.where(F.col("block") == k).select("bytes", "n").collect()]


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """[id_col, size, text_crc32, law, shard, slot, grown_shard]: one row per row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = column(text_col).cast("string").cast("binary")
    rows = docs.select(
        column(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("text_key"),
    )
    rows = scratch.save(rows, "rows")
    n = rows.count()
    # Summed up in each task first: a text that a third of the rows hold is one row from each task.
    groups = scratch.save(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "groups", blocks_for(n))
    placed = scratch.save(ranked(groups, ["bytes"], F.col("text_key"), [F.col("text_key")], blocks_for(groups.count()), "rank"), "placed", blocks_for(n))
    loads, schema = [0] * shards, "of long, ranges array<struct<past: long, shard: int>>"
    plan = scratch.save(spark.createDataFrame([], schema), "plan")
    for block in size_blocks(placed.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), scratch):
        spark.createDataFrame(schedule(block, loads), schema).coalesce(1).write.mode("append").parquet(f"{scratch.path}/plan")
    plan = spark.read.schema(schema).parquet(f"{scratch.path}/plan")
    homes = placed.join(plan, F.col("bytes") == F.col("of")).select("text_key", F.expr("filter(ranges, r -> r.past > rank)[0].shard").alias("shard"))
    sharded = scratch.save(rows.join(homes, "text_key"), "sharded")
    slots = ranked(sharded, ["shard"], F.struct("id", "text_key"), [F.col("id"), F.col("text_key")], blocks_for(n), "slot")
    return slots.select(
        F.col("id").alias(id_col),
        "size",
        F.coalesce("crc", F.lit(0).cast("long")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
