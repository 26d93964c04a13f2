"""Connected components in DataFrame operations: pointer jumping on forests, star steps on other graphs.

Every join has two written tables as its sides, so that adaptive execution can split the rows of a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def roots(parents: DataFrame) -> DataFrame:
    """parents (node, label), one row a node, without circles: each node with the root of its tree. The result is written.

    Each round replaces a parent by its parent, which halves the distance to the root, until no parent has one.
    """
    now = written(parents.select("node", "label"), "forest")
    while True:
        up = now.select(F.col("node").alias("label"), F.col("label").alias("above"))
        joined = written(now.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "forest")
        discard(now)
        now = joined
        if now.where("moved").isEmpty():
            return now.drop("moved")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: larger neighbours of u move to u's least neighbour; small: all smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    both = written(both, "both") if large else edges
    joined = both.join(least, "u")
    if large:  # u's own link to its least neighbour stays
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    out = written(moved.where("u <> v").distinct(), "stars")
    discard(least, *([both] if large else []))
    return out


def components(links: DataFrame) -> DataFrame:
    """links (x, y): rows (node, label) of all linked nodes, label the least node of the component.

    Large-star and small-star steps alternate until one round changes nothing. Links from a node to itself count for
    nothing; no links give no rows.
    """
    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    mark = None
    while True:
        large = _star(edges, True)
        small = _star(large, False)
        discard(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        mark = now
