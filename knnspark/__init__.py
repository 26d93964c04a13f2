"""Exact and approximate nearest-neighbour search over vector tables, in Spark DataFrames."""

from .operators.evaluate import Evaluator
from .operators.exact import brute_force
from .operators.index import VectorIndex
from .plans.graph_config import GraphConfig
from .sources.vecs import from_numpy, read_vecs, register_sources, write_vecs
from .types import EngineConfig, Measure

__all__ = ["EngineConfig", "Evaluator", "GraphConfig", "Measure", "VectorIndex", "brute_force", "from_numpy", "read_vecs", "register_sources", "write_vecs"]
