"""Sizes of the layered search graph, derived from the number of points and edges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

LAYERS = 4


@dataclass(frozen=True)
class GraphConfig:
    """k edges a node, the last kf of them inverse links; s points a segment (s0, and one more in
    the first s0_off, on layer 0); g lower segments under an upper one, sg points sent up by each
    (one more by the first sg_off)."""

    n: int
    k: int
    kf: int
    s: int
    g: int
    s0: int
    s0_off: int
    sg: int
    sg_off: int

    @classmethod
    def derive(cls, n: int, k: int) -> GraphConfig:
        kf = k // 2
        # Segments hold more points than a node has local links.
        s = -(-(max(kf, k - kf) + 1) // 32) * 32
        if n < s:
            raise ValueError(f"{n} points are too few for segments of {s}; search exactly instead")
        growth = int(np.float32(n / s) ** np.float32(1 / (LAYERS - 1)))
        growth = max(1, growth)
        sizes = {g: float(np.float32(n) / np.float32(g) ** np.float32(LAYERS - 1)) for g in (growth, growth + 1)}
        # The larger bottom segments win when they are nearer to s, or the smaller ones cannot fill a node's edges.
        keep = int(sizes[growth + 1]) < k or abs(sizes[growth] - s) < abs(sizes[growth + 1] - s)
        g = growth if keep else growth + 1
        s0 = int(sizes[g])
        return cls(n, k, kf, s, g, s0, n - g ** (LAYERS - 1) * s0, s // g, s - s // g * g)

    @property
    def kl(self) -> int:
        return self.k - self.kf

    @property
    def segments(self) -> tuple[int, ...]:
        return tuple(self.g ** (LAYERS - 1 - layer) for layer in range(LAYERS))

    @property
    def points(self) -> tuple[int, ...]:
        return (self.n, *(b * self.s for b in self.segments[1:]))

    @property
    def points_of_all_layers(self) -> int:
        return sum(self.points)

    @property
    def upper_points(self) -> int:
        return sum(self.points[1:])

    def segment_of(self, layer: int, ids: np.ndarray) -> np.ndarray:
        if layer:
            return ids // self.s
        long = self.s0_off * (self.s0 + 1)
        return np.where(ids < long, ids // (self.s0 + 1), (ids - self.s0_off) // self.s0)

    def bounds(self, layer: int, segment: int) -> tuple[int, int]:
        """First point of a segment and the one after its last."""
        if layer:
            return segment * self.s, (segment + 1) * self.s
        first = segment * self.s0 + min(segment, self.s0_off)
        return first, first + self.s0 + (segment < self.s0_off)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        rows = [(layer, self.segments[layer], self.points[layer], sum(self.points[:layer]), self.s if layer else self.s0, self.g, self.sg, self.sg_off) for layer in range(LAYERS)]
        return spark.createDataFrame(rows, "layer int, n_segments bigint, n_points bigint, first_point bigint, segment_size bigint, growth bigint, sent_up bigint, sent_up_extra bigint")


def search_sizes(k: int, max_iterations: int) -> tuple[int, int]:
    """Length of the sorted part (results and queue) and of the whole cache of a search."""
    need = -(-(k + 1 + 16) // 32) * 32
    power = 1 << max(0, (max_iterations - 1).bit_length())
    cache = max(256, need + 32, power)
    return max(64 if cache < 512 else 32, need), cache
