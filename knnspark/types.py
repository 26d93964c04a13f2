"""Measures, engine settings and the schemas of results."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from enum import Enum

log = logging.getLogger("knnspark")

RESULT_SCHEMA = "q_id bigint, vec_id bigint, dist double"
GRAPH_SCHEMA = "shard_id int, layer int, node_id int, vec_id bigint, neighbors array<int>, selection int, translation int"
STATS_SCHEMA = "shard_id int, nn1_mean double, nn1_max double"

MAX_VECTORS, MAX_DIMS, MAX_EDGES, MAX_NEIGHBOURS, MAX_ITERATIONS = (1 << 31) - 1, 4096, 512, 6000, 8192


class Measure(str, Enum):
    """Euclidean distances are squared; cosine ones are abs(1 - cosine), 1 for a zero vector."""

    EUCLIDEAN = "euclidean"
    COSINE = "cosine"

    @classmethod
    def of(cls, value: Measure | str) -> Measure:
        try:
            return cls(value.value if isinstance(value, cls) else str(value).lower())
        except ValueError:
            raise ValueError(f"measure must be euclidean or cosine, not {value!r}") from None


@dataclass(frozen=True)
class EngineConfig:
    """shard_size: points a shard holds at most (None: one shard); strict_shards: the number of points must be a multiple of it."""

    working_dir: str | None = None
    shard_size: int | None = None
    strict_shards: bool = False
    query_block: int = 4096

    def __post_init__(self) -> None:
        if self.shard_size is not None and self.shard_size < 1:
            raise ValueError("shard_size must be positive")
        if self.query_block < 1:
            raise ValueError("query_block must be positive")


def check_build(k_build: int, tau_build: float, refinement_iterations: int) -> None:
    if not 2 <= k_build <= MAX_EDGES:
        raise ValueError(f"k_build must be 2 to {MAX_EDGES}")
    if tau_build < 0:
        raise ValueError("tau_build must not be negative")
    if refinement_iterations < 0:
        raise ValueError("refinement_iterations must not be negative")


def check_query(k: int, tau: float = 0.0, max_iterations: int = 1) -> None:
    if not 1 <= k <= MAX_NEIGHBOURS:
        raise ValueError(f"k must be 1 to {MAX_NEIGHBOURS}")
    if tau < 0:
        raise ValueError("tau_query must not be negative")
    if not 1 <= max_iterations <= MAX_ITERATIONS:
        raise ValueError(f"max_iterations must be 1 to {MAX_ITERATIONS}")
