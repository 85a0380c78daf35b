"""Property graphs on Spark DataFrames."""

from loomgraph.functions.edges import canonicalize, dedupe_edges, drop_self_loops, symmetrize, to_edges, validate_edges
from loomgraph.functions.optional import has_local_extra, require_numpy
from loomgraph.names import ORIGINAL
from loomgraph.operators.community import label_propagation, power_iteration_clustering
from loomgraph.operators.components import connected_components, has_cycle, large_star, small_star, strongly_connected_components, vertices_on_cycles
from loomgraph.operators.factor import SvdPlusPlusResult, svd_plus_plus
from loomgraph.operators.graph import DirectedGraph, Graph, UndirectedGraph
from loomgraph.operators.messages import aggregate_messages, pregel
from loomgraph.operators.motifs import find
from loomgraph.operators.paths import all_paths, all_paths_frame, all_shortest_paths, all_shortest_paths_frame, bfs, bfs_paths, random_walks, random_walks_frame, shortest_paths
from loomgraph.operators.rank import pagerank, parallel_personalized_pagerank
from loomgraph.operators.relabel import IndexedGraph, reindex, restore_ids
from loomgraph.operators.structure import hyper_anf, k_core, maximal_independent_set, triangle_count
from loomgraph.plans.fixed_point import iterate_to_fixed_point, same_rows
from loomgraph.plans.motif_grammar import parse_motif

__version__ = "0.1.0"

__all__ = [
    "ORIGINAL", "DirectedGraph", "Graph", "IndexedGraph", "SvdPlusPlusResult", "UndirectedGraph", "aggregate_messages",
    "all_paths", "all_paths_frame", "all_shortest_paths", "all_shortest_paths_frame", "bfs", "bfs_paths", "canonicalize",
    "connected_components", "dedupe_edges", "drop_self_loops", "find", "has_cycle", "has_local_extra", "hyper_anf",
    "iterate_to_fixed_point", "k_core", "label_propagation", "large_star", "maximal_independent_set", "pagerank",
    "parallel_personalized_pagerank", "parse_motif", "power_iteration_clustering", "pregel", "random_walks",
    "random_walks_frame", "reindex", "require_numpy", "restore_ids", "same_rows", "shortest_paths", "small_star",
    "strongly_connected_components", "svd_plus_plus", "symmetrize", "to_edges", "triangle_count", "validate_edges",
    "vertices_on_cycles",
]
