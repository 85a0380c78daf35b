"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, blocks_for


def _least(edges: DataFrame, at: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(at).alias("node")).agg(F.min(other).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least node among it and its neighbours. Edges are (hi, lo)."""
    both = edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(edges.select("lo", "hi"))
    least = _least(both, "a", "b").select("node", F.least("node", "m").alias("m"))
    return edges.join(least, F.col("lo") == F.col("node")).select("hi", F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them."""
    least = _least(edges, "hi", "lo")
    moved = edges.join(least, F.col("hi") == F.col("node")).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct()


def _sized(edges: DataFrame, rows: int) -> DataFrame:
    """As many partitions as the edges need: rounds are many and mostly small."""
    return edges.coalesce(blocks_for(rows, 100_000))


def _saved(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, dict]:
    """The edges as written, with their number and two sums of hashes that are observed on the way."""
    seen = Observation()
    marks = F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("hi", "lo")).alias("mark"), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31))).alias("sum")
    return scratch.save(edges.observe(seen, *marks), name), seen.get


def components(edges: DataFrame, scratch: Scratch, name: str = "stars", max_rounds: int = 100) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is its least reachable node.

    Every round is one job, written to the shared folder. Edges of null ends and loops are left out. No edges give no rows.
    """
    now, seen = _saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), scratch, f"{name}-0")
    if not seen["rows"]:
        return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    for k in range(1, max_rounds + 1):
        before, rows = seen, seen["rows"]
        now, seen = _saved(_sized(small_star(large_star(_sized(now, rows))), rows), scratch, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        if seen == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
