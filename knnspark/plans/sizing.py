"""Shard sizes from the memory of a worker."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..types import MAX_VECTORS
from .graph_config import GraphConfig

#: Share of the memory that other things take, and copies of the vectors that building holds (as read, as doubles).
RESERVED, COPIES = 1 / 8, 2


def shard_bytes(points: int, dims: int, k_build: int) -> int:
    """What building a shard of so many points holds: vectors, and edges of all layers as 64-bit numbers."""
    try:
        edges = GraphConfig.derive(points, k_build).points_of_all_layers * k_build
    except ValueError:  # so few are searched exactly
        edges = 0
    return 8 * (COPIES * points * dims + edges)


def shard_size_for(memory: int, dims: int, k_build: int = 24, workers: int = 1) -> int:
    """The most points a shard may have for `workers` of them to be built at once in `memory` bytes; 1 at least."""
    room = int(memory * (1 - RESERVED)) // max(1, workers)
    low, high = 1, MAX_VECTORS
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if shard_bytes(middle, dims, k_build) <= room else (low, middle - 1)
    return low


def worker_memory(spark: SparkSession) -> tuple[int, int]:
    """Bytes that an executor's Python workers may take, and how many of them run at once."""
    conf = spark.sparkContext.getConf()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}

    def size(text: str) -> int:
        text = text.lower().removesuffix("b")
        return int(float(text[:-1]) * units[text[-1]]) if text[-1] in units else int(text) << 20

    memory = conf.get("spark.executor.pyspark.memory") or conf.get("spark.executor.memoryOverhead") or conf.get("spark.executor.memory") or "1g"
    cores = conf.get("spark.executor.cores") or "1"
    return size(memory), max(1, int(cores) // max(1, int(conf.get("spark.task.cpus") or "1")))
