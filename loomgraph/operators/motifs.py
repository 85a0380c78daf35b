"""Motif search: a pattern becomes a chain of joins, which Catalyst may reorder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.edges import name
from loomgraph.names import DST, ID, SRC
from loomgraph.operators.graph import DirectedGraph, endpoints
from loomgraph.plans.motif_grammar import EdgePattern, VertexPattern, is_named, parse_motif
from loomgraph.plans.store import Store


def _cycle(clauses: list) -> list[str] | None:
    """The corners a, b, c of a pattern that is the cycle (a)-[]->(b); (b)-[]->(c); (c)-[]->(a), with or without names of edges."""
    if len(clauses) != 3 or not all(isinstance(c, EdgePattern) and not c.negated for c in clauses):
        return None
    corners = [c.src for c in clauses]
    return corners if len(set(corners)) == 3 and [c.dst for c in clauses] == [*corners[1:], corners[0]] else None


def _cycles(ends: DataFrame, corners: list[str]) -> DataFrame:
    """Matches of a cycle of three, a row for each choice of its edges.

    Each is found once, from a corner p of least degree (then id) with edges p to q, q to r and r to p, so that a third as
    many pairs of edges are looked up as there are paths of two, and few at hubs; then it is turned. A cycle that passes
    its least corner twice, by a loop, begins at either place, so not all of its turns count.
    """
    ends = Store(ends.sparkSession).keep(ends)
    ranked, degrees = ends, endpoints(ends).groupBy(ID).agg(F.count(F.lit(1)).alias("d"))
    for end in (SRC, DST):
        ranked = ranked.join(degrees.select(F.col(ID).alias(end), F.struct("d", ID).alias(f"{end}_rank")), end)
    out = ranked.where("src_rank <= dst_rank").select(F.col(SRC).alias("p"), F.col(DST).alias("q"))
    back = ranked.where("dst_rank <= src_rank").select(F.col(DST).alias("p"), F.col(SRC).alias("r"))
    found = out.join(back, "p").join(ends.select(F.col(SRC).alias("q"), F.col(DST).alias("r")), ["q", "r"])
    turn = lambda *at: F.struct(*[F.col(x).alias(c) for x, c in zip(at, corners)])
    turns = F.array(turn("p", "q", "r"), F.when(F.col("p") != F.col("r"), turn("r", "p", "q")), F.when((F.col("p") != F.col("q")) & (F.col("p") != F.col("r")), turn("q", "r", "p")))
    return found.select(F.explode(turns).alias("match")).where("match is not null").select("match.*")


def find(graph: DirectedGraph, pattern: str) -> DataFrame:
    """One row per match: a struct for each named vertex and edge, in the order of their first mention.

    Named vertices must be in the vertex table; unnamed ones only bind the ends of edges. A named edge is matched with
    every row of its pair of ends, so parallel edges multiply matches. A negated edge, wherever it stands, removes
    matches between whose bound ends the edge exists.
    """
    clauses = parse_motif(pattern)
    ids = graph.vertices.select(F.col(ID)).distinct()
    ends = graph.edges.select(SRC, DST)
    mentioned: list[tuple[str, str]] = []
    matches: DataFrame | None = None

    def mention(kind: str, element: str | None) -> None:
        if element and is_named(element) and element not in [e for _, e in mentioned]:
            mentioned.append((kind, element))
        elif element and is_named(element) and (kind, element) not in mentioned:
            raise ValueError(f"{element!r} names both a vertex and an edge")

    def joined(other: DataFrame) -> DataFrame:
        if matches is None:
            return other
        shared = [c for c in other.columns if c in matches.columns]
        # Clauses without a common name are a product by the meaning of the pattern.
        return matches.join(other, shared) if shared else matches.crossJoin(other)

    if corners := _cycle(clauses):
        matches = _cycles(ends, corners)
    for clause in clauses:
        if isinstance(clause, VertexPattern):
            mention("vertex", clause.name)
            if matches is None or clause.name not in matches.columns:
                matches = joined(ids.select(F.col(ID).alias(clause.name)))
            continue
        if clause.src == clause.dst:
            raise ValueError(f"an edge from a vertex to itself is not supported: ({clause.src})")
        if clause.negated:
            continue
        mention("vertex", clause.src)
        if clause.edge and ("edge", clause.edge) in mentioned:
            raise ValueError(f"the edge {clause.edge!r} is named twice")
        mention("edge", clause.edge)
        mention("vertex", clause.dst)
        if corners:
            continue
        matches = joined(ends.select(F.col(SRC).alias(clause.src), F.col(DST).alias(clause.dst)))
    for clause in clauses:
        if isinstance(clause, EdgePattern) and clause.negated:
            if matches is None or clause.src not in matches.columns or clause.dst not in matches.columns:
                raise ValueError("both ends of a negated edge must be bound by another clause")
            matches = matches.join(ends.select(F.col(SRC).alias(clause.src), F.col(DST).alias(clause.dst)), [clause.src, clause.dst], "left_anti")
    assert matches is not None
    bound = {c.edge: c for c in clauses if isinstance(c, EdgePattern) and c.edge}
    for kind, element in mentioned:
        if kind == "edge":
            rows = graph.edges.select(F.col(SRC).alias(bound[element].src), F.col(DST).alias(bound[element].dst), F.struct(*map(name, graph.edges.columns)).alias(f"__{element}"))
            matches = matches.join(rows, [bound[element].src, bound[element].dst])
    # All that is known of a vertex is its id where the edges' ends are the vertices.
    plain = graph.derived and graph.vertices.columns == [ID]
    for kind, element in mentioned:
        if kind == "vertex" and plain:
            matches = matches.where(F.col(element).isNotNull()).withColumn(f"__{element}", F.struct(F.col(element).alias(ID)))
        elif kind == "vertex":
            rows = graph.vertices.select(F.col(ID).alias(element), F.struct(*map(name, graph.vertices.columns)).alias(f"__{element}"))
            matches = matches.join(rows, element)
    return matches.select(*[F.col(f"__{element}").alias(element) for _, element in mentioned])
