"""Functions on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.names import DST, SRC


def predicate(condition: Column | str) -> Column:
    """A condition given as a Column or as SQL text."""
    return F.expr(condition) if isinstance(condition, str) else condition


def name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def to_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """The two columns as src and dst."""
    return df.select(name(src).alias(SRC), name(dst).alias(DST))


def validate_edges(edges: DataFrame) -> DataFrame:
    """The same frame, or a ValueError that says which of src and dst it lacks."""
    if lacking := [c for c in (SRC, DST) if c not in edges.columns]:
        raise ValueError(f"edges lack the columns {lacking}; they have {edges.columns}")
    return edges


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col(SRC) != F.col(DST))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs; other columns go."""
    return edges.select(SRC, DST).distinct()


def canonicalize(edges: DataFrame) -> DataFrame:
    """The simple undirected graph: distinct pairs with src < dst."""
    return dedupe_edges(drop_self_loops(edges).select(F.least(SRC, DST).alias(SRC), F.greatest(SRC, DST).alias(DST)))


def flipped(edges: DataFrame) -> DataFrame:
    """Every edge turned round, columns in their places."""
    other = {SRC: DST, DST: SRC}
    return edges.select(*[name(other.get(c, c)).alias(c) for c in edges.columns])


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop is there twice."""
    return edges.union(flipped(edges))
