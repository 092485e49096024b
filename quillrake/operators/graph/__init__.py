"""Graph analytics over edge tables.

An edge table has a source and a target column of whole numbers and perhaps a weight. Edges with a null end are
ignored. The nodes are all sources and targets. Unless stated, repeated edges count once and edges are directed.

Iterative algorithms have two ways with the same results: ``out_of_core`` is a loop of DataFrame steps, each cut by a
table in the shared folder; ``in_memory`` is one task over compressed adjacency, for graphs of up to ``LOCAL_EDGES``
edges. ``auto`` counts the edges and chooses.
"""

from .edges import LOCAL_EDGES, edge_table
from .groups import connected_components, label_propagation, leiden, louvain, modularity, strongly_connected_components, topological_levels
from .measures import adamic_adar, average_path_length, betweenness, closeness, clustering_coefficient, common_neighbor_scores, degrees, density, jaccard, preferential_attachment, resource_allocation, triangle_count
from .rank import pagerank, personalized_pagerank
from .walks import all_shortest_paths, bfs, connecting_paths, neighbors, shortest_path, subgraph

__all__ = [
    "LOCAL_EDGES", "adamic_adar", "all_shortest_paths", "average_path_length", "betweenness", "bfs", "closeness", "clustering_coefficient", "common_neighbor_scores", "connected_components", "connecting_paths",
    "degrees", "density", "edge_table", "jaccard", "label_propagation", "leiden", "louvain", "modularity", "neighbors", "pagerank", "personalized_pagerank", "preferential_attachment", "resource_allocation",
    "shortest_path", "strongly_connected_components", "subgraph", "topological_levels", "triangle_count",
]
