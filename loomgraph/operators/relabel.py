"""Contiguous integer ids for graphs keyed by anything that sorts, and the way back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Generic, TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.edges import name
from loomgraph.names import DST, ID, ORIGINAL, SRC
from loomgraph.operators.graph import Graph
from loomgraph.plans.store import Store

GraphT = TypeVar("GraphT", bound=Graph)
_RESERVED = "__new_"


@dataclass(frozen=True)
class IndexedGraph(Generic[GraphT]):
    graph: GraphT
    mapping: DataFrame


def numbered(ids: DataFrame, store: Store) -> DataFrame:
    """[original_id, id]: places in sorted order, from 0.

    Ids are dealt to ranges, each range is ranked on its own, and the ranges' counts say where each begins. The ranges
    are written first, since a range's borders come from a sample.
    """
    dealt = store.keep(ids.repartitionByRange(ORIGINAL).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(ORIGINAL)) - 1
    return dealt.withColumn("place", place).join(starts, "range").select(ORIGINAL, (F.col("start") + F.col("place")).cast("bigint").alias(ID))


def reindex(graph: GraphT) -> IndexedGraph[GraphT]:
    """The graph with ids 0 to n - 1 in the order of the old ones, and the mapping [original_id, id].

    Edges with an end outside the vertex table are dropped; attributes and the flavor stay.
    """
    for df in (graph.edges, graph.vertices):
        if taken := [c for c in df.columns if c.startswith(_RESERVED)]:
            raise ValueError(f"columns {taken} clash with internal names")
    store = Store(graph.edges.sparkSession)
    mapping = store.keep(numbered(graph.vertices.select(F.col(ID).alias(ORIGINAL)).distinct(), store))

    def renumbered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        out = df
        for c in columns:
            out = out.join(mapping.select(F.col(ORIGINAL).alias(c), F.col(ID).alias(_RESERVED + c)), c)
        return out.select(*[name(_RESERVED + c).alias(c) if c in columns else name(c) for c in df.columns])

    return IndexedGraph(type(graph)(renumbered(graph.edges, (SRC, DST)), renumbered(graph.vertices, (ID,))), mapping)


def restore_ids(df: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the given id columns mapped back, in place; ids that the mapping lacks become null."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing from {df.columns}")
    if taken := [c for c in df.columns if c.startswith(_RESERVED)]:
        raise ValueError(f"columns {taken} clash with internal names")
    out = df
    for c in columns:
        back = mapping.select(F.col(ID).alias(_RESERVED + "id"), F.col(ORIGINAL).alias(_RESERVED + "old"))
        out = out.join(back, name(c) == F.col(_RESERVED + "id"), "left").select(*[F.col(_RESERVED + "old").alias(c) if x == c else name(x) for x in df.columns])
    return out
