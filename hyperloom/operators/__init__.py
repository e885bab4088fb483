"""Operators on nodes and edges as DataFrames."""

from . import delta, features, graph, kernel, knowledge, learned, mining, partition, ranking, stages
from .graph import cycles, find_cycles, line_graph
from .knowledge import builtin, empty, index, match
from .learned import Compressor as LearnedCompressor
from .learned import Network
from .mining import correlations, frequent_predicates, learn, learn_graphs, to_patterns

__all__ = [
    "LearnedCompressor", "Network", "builtin", "correlations", "cycles", "delta", "empty", "features", "find_cycles", "frequent_predicates", "graph", "index", "kernel",
    "knowledge", "learn", "learn_graphs", "learned", "line_graph", "match", "mining", "partition", "ranking", "stages", "to_patterns",
]
