"""Recall and speed of an index over a range of tau_query; `python -m knnspark.plans.sweep --help`."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import Evaluator, truth_distances
from ..operators.index import VectorIndex
from ..sources.vecs import read_vecs
from ..types import EngineConfig, Measure, log

TAUS = (0.34, 0.41, 0.51, 0.64)
GRID = tuple(k / 100 for k in range(70)) + tuple(k / 10 for k in range(7, 21))


def read_vectors(spark: SparkSession, path: str, num: int | None = None) -> DataFrame:
    """A vecs file or folder, or Parquet with vec_id and embedding."""
    if path.rstrip("/").rsplit(".", 1)[-1] in ("fvecs", "bvecs", "ivecs"):
        return read_vecs(spark, path, num=num)
    df = spark.read.parquet(path).select("vec_id", "embedding")
    return df if num is None else df.where(F.col("vec_id") < num)


def ground_truth(index: VectorIndex, queries: DataFrame, k: int, measure: Measure | str, path: str | None = None) -> DataFrame:
    """Reads an ivecs file or stored Parquet, else computes it with the given measure (and stores it)."""
    spark = queries.sparkSession
    if path and path.rstrip("/").endswith("ivecs"):
        rows = read_vecs(spark, path)
        return rows.select(F.col("vec_id").alias("q_id"), F.posexplode("embedding").alias("p", "v")).select("q_id", (F.col("p") + 1).alias("rk"), F.col("v").cast("bigint").alias("vec_id"))
    if path:
        try:
            return spark.read.parquet(path)
        except Exception as why:  # noqa: BLE001  nothing stored there, as Spark's readers put it
            if "PATH_NOT_FOUND" not in str(why):
                raise
    truth = index.bf_query(queries, k, measure)
    if path:
        truth.write.parquet(path)
        return spark.read.parquet(path)
    return truth


def sweep(index: VectorIndex, queries: DataFrame, truth: DataFrame, k: int = 10, taus: tuple[float, ...] = TAUS, max_iterations: int = 200, measure: Measure | str = Measure.EUCLIDEAN) -> DataFrame:
    """One row per tau: the metrics, seconds and microseconds a query."""
    spark = queries.sparkSession
    asked = queries.select(F.col("vec_id").alias("q_id"), "embedding")
    judge = Evaluator(truth, k, index.base, asked, measure)
    n, rows = max(1, queries.count()), []
    for tau in taus:
        began = time.time()
        found = index.query(queries, k, tau, max_iterations, measure).persist()
        found.count()
        seconds = time.time() - began
        metrics = judge.evaluate_results(found).head().asDict()
        found.unpersist()
        log.info("tau %.2f: %s, %.1f us a query", tau, metrics, seconds / n * 1e6)
        rows.append({"tau_query": tau, **metrics, "seconds": seconds, "us_per_query": seconds / n * 1e6})
    return spark.createDataFrame(rows)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--base", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--gt")
    p.add_argument("--graph_dir")
    p.add_argument("--subset", type=int)
    p.add_argument("--k_build", type=int, default=24)
    p.add_argument("--tau_build", type=float, default=0.5)
    p.add_argument("--refinement_iterations", type=int, default=2)
    p.add_argument("--k_query", type=int, default=10)
    p.add_argument("--max_iterations", type=int, default=200)
    p.add_argument("--measure", default="euclidean")
    p.add_argument("--shard_size", type=int)
    p.add_argument("--grid_search", action="store_true")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    index = VectorIndex(spark, EngineConfig(a.graph_dir, a.shard_size)).set_base(read_vectors(spark, a.base, a.subset))
    options = {"k_build": a.k_build, "tau_build": a.tau_build, "refinement_iterations": a.refinement_iterations, "measure": a.measure}
    index.load_or_build(**options) if a.graph_dir else index.build(**options)
    queries = read_vectors(spark, a.query)
    truth = ground_truth(index, queries, max(100, a.k_query), a.measure, a.gt)
    sweep(index, queries, truth, a.k_query, GRID if a.grid_search else TAUS, a.max_iterations, a.measure).show(100, truncate=False)


__all__ = ["GRID", "TAUS", "ground_truth", "read_vectors", "sweep", "truth_distances"]

if __name__ == "__main__":
    main()
