"""Graph-construction steps that are relational, in their DataFrame form.

points: rows (node, vec_id, embedding, segment) of a layer; node is the layer-local id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance, slack
from ..plans.graph_config import GraphConfig
from ..types import Measure
from .exact import top_k

#: Added to a point's nearest distance in the selection key: the unit roundoff step of 32-bit floats.
FLOAT_STEP = 2.0**-23


def segment_of(node: Column, config: GraphConfig, layer: int = 0) -> Column:
    if layer:
        return F.floor(node / F.lit(config.s)).cast("int")
    long = config.s0_off * (config.s0 + 1)
    return F.floor(F.when(node < long, node / F.lit(config.s0 + 1)).otherwise((node - config.s0_off) / F.lit(config.s0))).cast("int")


def ancestor_point(segment: Column, config: GraphConfig, bottom: int, top: int) -> Column:
    """First point, in layer top, of the segment above a segment of layer bottom."""
    return (F.floor(segment / F.lit(config.g ** (top - bottom))) * config.s).cast("bigint")


def bottom_points(base: DataFrame, config: GraphConfig) -> DataFrame:
    """Layer 0 of a base with ids 0 to n - 1."""
    return base.select(F.col("vec_id").alias("node"), "vec_id", "embedding", segment_of(F.col("vec_id"), config).alias("segment"))


def segment_knn(points: DataFrame, k: int, measure: Measure | str = Measure.EUCLIDEAN, dims: int | None = None) -> DataFrame:
    """(node, segment, rk, neighbor, dist): the k nearest other points of the same segment, by (dist, neighbor)."""
    a = points.select("segment", "node", F.col("embedding").alias("a"))
    b = points.select("segment", F.col("node").alias("neighbor"), F.col("embedding").alias("b"))
    pairs = a.join(b, "segment").where("node <> neighbor").select("segment", F.col("node").alias("q_id"), F.col("neighbor").alias("vec_id"), distance(F.col("a"), F.col("b"), measure, dims).alias("dist"))
    return top_k(pairs, k).select(F.col("q_id").alias("node"), "segment", "rk", F.col("vec_id").alias("neighbor"), "dist")


def nearest_distances(edges: DataFrame, rank: int = 2, measure: Measure | str = Measure.EUCLIDEAN) -> DataFrame:
    """(node, segment, nn1): the distance of the neighbour of that rank, Euclidean with its root."""
    dist = F.sqrt("dist") if Measure.of(measure) is Measure.EUCLIDEAN else F.col("dist")
    return edges.where(F.col("rk") == rank).select("node", "segment", dist.alias("nn1"))


def nn1_stats(nn1: DataFrame) -> DataFrame:
    return nn1.agg(F.avg("nn1").alias("nn1_mean"), F.max("nn1").alias("nn1_max"))


def slacks(stats: DataFrame, tau_build: float, tau_query: float, measure: Measure | str = Measure.EUCLIDEAN) -> DataFrame:
    return stats.select(slack(F.col("nn1_mean"), tau_build, measure).alias("xi_build"), slack(F.col("nn1_max"), tau_query, measure).alias("xi_query"))


def hashed_unit(node: Column, layer: int) -> Column:
    """The kernel's fixed numbers in (0, 1]."""
    return ((node.cast("bigint") * 2654435761 + (layer + 1) * 40503) % (1 << 32) + 1) / F.lit(float(1 << 32))


def select_up(nn1: DataFrame, config: GraphConfig, layer: int = 0) -> DataFrame:
    """(node, selection) of the layer above: its new local ids and the ids they have in this layer."""
    key = -F.log(hashed_unit(F.col("node"), layer)) / (F.col("nn1") + FLOAT_STEP)
    ranked = nn1.withColumn("pos", F.row_number().over(Window.partitionBy("segment").orderBy(key.desc(), "node")) - 1)
    upper, nth = F.floor(F.col("segment") / F.lit(config.g)), F.col("segment") % config.g
    chosen = ranked.where(F.col("pos") < config.sg + (nth < config.sg_off).cast("int"))
    node = upper * config.s + nth * config.sg + F.least(nth, F.lit(config.sg_off)) + F.col("pos")
    return chosen.select(node.cast("bigint").alias("node"), F.col("node").alias("selection"))


def upper_points(selected: DataFrame, points: DataFrame, config: GraphConfig, layer: int) -> DataFrame:
    """Points of the layer above: selection joined to this layer's rows; vec_id is the translation to the base."""
    below = points.select(F.col("node").alias("selection"), "vec_id", "embedding")
    return selected.join(below, "selection").select("node", "vec_id", "embedding", segment_of(F.col("node"), config, layer).alias("segment"))


def reverse_links(edges: DataFrame, config: GraphConfig) -> DataFrame:
    """(node, source, dist, pos): local links without a link back, turned round, nearest first."""
    local = edges.where(F.col("rk") <= config.kl).select("node", "neighbor", "dist")
    back = local.select(F.col("neighbor").alias("node"), F.col("node").alias("neighbor"))
    lone = local.join(back, ["node", "neighbor"], "left_anti")
    order = Window.partitionBy("node").orderBy("dist", "source")
    return lone.select(F.col("neighbor").alias("node"), F.col("node").alias("source"), "dist").withColumn("pos", F.row_number().over(order))


def foreign_links(edges: DataFrame, asked: DataFrame, config: GraphConfig) -> DataFrame:
    """(node, slot, neighbor): links asked for first, then old foreign links that are not among them, then the node itself."""
    new = asked.where(F.col("pos") <= config.kf).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("new"))
    old = edges.where(F.col("rk") > config.kl).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "neighbor"))), lambda x: x["neighbor"]).alias("old"))
    nodes = edges.select("node").distinct()
    none = F.array().cast("array<bigint>")
    joined = nodes.join(new, "node", "left").join(old, "node", "left")
    merged = F.array_distinct(F.concat(F.coalesce("new", none), F.coalesce("old", none)))
    filled = F.slice(F.concat(merged, F.array_repeat(F.col("node"), config.kf)), 1, config.kf)
    return joined.select("node", F.posexplode(filled).alias("slot", "neighbor"))


def link_overflow(asked: DataFrame, config: GraphConfig) -> DataFrame:
    """One row: nodes asked for more links than they have room for, and links added."""
    per = asked.groupBy("node").agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") > config.kf).alias("n_overflow"), F.coalesce(F.sum(F.least("n", F.lit(config.kf))), F.lit(0)).alias("n_added"))
