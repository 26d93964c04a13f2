"""The engine's queries over the project's tables, and the same in DuckDB SQL.

Searches take as queries every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import HALF, distance, half_point, l2, norm2, register_functions, register_knn
from .operators import layers, sharding
from .operators.evaluate import Evaluator, duplicate_ends
from .operators.exact import all_pairs, block_l2, brute_force, top_k, uniform
from .operators.index import VectorIndex, wide_results
from .plans.graph_config import GraphConfig
from .plans.sizing import shard_bytes, shard_size_for
from .sources.scratch import scratch_path
from .sources.vecs import read_vecs, write_vecs
from .types import MAX_ITERATIONS, EngineConfig, Measure, log

EVERY, K, SHARD, K_BUILD, DIMS = 20, 10, 128, 24, 64
ANN_SHARD = 1000


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("vec_id") % EVERY == 0)


def byte_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components scaled to whole numbers 0 to 255."""
    scaled = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("smallint"))
    return base(spark, sf_dir).select("vec_id", scaled.alias("embedding"))


def tie_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 10).cast("double")).alias("embedding"))


def _result(df: DataFrame) -> DataFrame:
    return df.select("q_id", "vec_id", "dist", F.col("rk").cast("bigint").alias("rk"))


def _bf(measure: str, k: int = K, source=base, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = source(spark, sf_dir)
        return _result(brute_force(b, asked(b), k, measure, **options))

    return run


def _pairs(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    """All pairs with their distance: blocks of rows in numpy, by of(blocks); where vectors are missing or differ in length, pairs by pairs."""
    b = base(spark, sf_dir)
    q = asked(b).withColumnRenamed("vec_id", "q_id")
    if uniform(b):
        return all_pairs(b, q, of)
    return q.withColumnRenamed("embedding", "q").crossJoin(b.withColumnRenamed("embedding", "b"))


def pairwise_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, lambda q, b: np.sqrt(block_l2(q, b)))
    return pairs if "dist" in pairs.columns else pairs.select("q_id", "vec_id", l2(F.col("q"), F.col("b"), DIMS).alias("dist"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("vec_id", F.size("embedding").cast("bigint").alias("dims"), norm2(F.col("embedding"), DIMS).alias("norm2"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


def half_point_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, lambda q, b: block_l2(q, b, HALF))
    if "dist" in pairs.columns:
        return pairs
    pairs = pairs.select("q_id", "vec_id", "b", half_point(F.col("q"), F.col("b")).alias("h"))
    return pairs.select("q_id", "vec_id", distance(F.col("h"), F.col("b"), "euclidean", DIMS).alias("dist"))


def base_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 100 to 299 by id: the filter reaches the scan."""
    return base(spark, sf_dir).where((F.col("vec_id") >= 100) & (F.col("vec_id") < 300)).select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, called from SQL."""
    register_functions(spark)
    return spark.sql("SELECT vec_id, vec_l2(embedding, embedding) AS self_l2, vec_cosine(embedding, vec_half(embedding, embedding)) AS self_cosine, vec_norm2(embedding) AS norm2 FROM {b}", b=base(spark, sf_dir))


def knn_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search written in SQL alone, through a table function over a view."""
    b = base(spark, sf_dir)
    b.createOrReplaceTempView("knn_table_function_base")
    asked(b).createOrReplaceTempView("knn_table_function_queries")
    register_knn(spark, "knn_of_base", "knn_table_function_base")
    return spark.sql(f"SELECT q.vec_id AS q_id, n.vec_id, n.dist, n.rk FROM knn_table_function_queries q, LATERAL knn_of_base(CAST(q.embedding AS ARRAY<DOUBLE>), {K}) n")


def _shard_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return brute_force(b, asked(b), K, shard_size=SHARD)


def sharded_partial_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _shard_results(spark, sf_dir)
    return r.select("q_id", F.col("shard_id").cast("bigint").alias("shard_id"), "vec_id", "dist", F.col("rk").cast("bigint").alias("rk"))


def sharded_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(sharding.merge_top_k(_shard_results(spark, sf_dir), K))


def sharded_unmerged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(sharding.unmerged(_shard_results(spark, sf_dir)))


def _config(b: DataFrame) -> GraphConfig:
    return GraphConfig.derive(b.count(), K_BUILD)


def graph_config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _config(base(spark, sf_dir)).dataframe(spark).withColumn("layer", F.col("layer").cast("bigint"))


def segment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return layers.bottom_points(b, _config(b)).select("vec_id", F.col("segment").cast("bigint").alias("segment"))


def ancestor_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    c = _config(b)
    p = layers.bottom_points(b, c)
    return p.select("vec_id", *[layers.ancestor_point(F.col("segment"), c, 0, top).alias(f"top{top}") for top in (1, 2, 3)])


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GraphConfig, DataFrame]:
    b = base(spark, sf_dir)
    c = _config(b)
    points = layers.bottom_points(b, c)
    return layers.segment_knn(points, c.k, dims=DIMS), c, points


def segment_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, _ = _edges(spark, sf_dir)
    return edges.select("node", F.col("rk").cast("bigint").alias("rk"), "neighbor", "dist")


def segment_nn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, _ = _edges(spark, sf_dir)
    return layers.nearest_distances(edges).select("node", "nn1")


def nn1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, _ = _edges(spark, sf_dir)
    return layers.nn1_stats(layers.nearest_distances(edges)).select(F.round("nn1_mean", 6).alias("nn1_mean"), F.round("nn1_max", 6).alias("nn1_max"))


def xi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, _ = _edges(spark, sf_dir)
    xi = layers.slacks(layers.nn1_stats(layers.nearest_distances(edges)), 0.5, 0.64)
    return xi.select(F.round("xi_build", 6).alias("xi_build"), F.round("xi_query", 6).alias("xi_query"))


def layer_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, c, _ = _edges(spark, sf_dir)
    return layers.select_up(layers.nearest_distances(edges), c)


def _layer_one(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GraphConfig]:
    edges, c, points = _edges(spark, sf_dir)
    return layers.upper_points(layers.select_up(layers.nearest_distances(edges), c), points, c, 1), c


def layer_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer 2's ids in layer 1 and in the base."""
    one, c = _layer_one(spark, sf_dir)
    near = layers.nearest_distances(layers.segment_knn(one, c.k, dims=DIMS))
    up = layers.select_up(near, c, 1)
    two = layers.upper_points(up, one, c, 2)
    return two.join(up, "node").select("node", "selection", F.col("vec_id").alias("translation"))


def start_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base ids of layer 1's first segment, with their squared norms."""
    one, _ = _layer_one(spark, sf_dir)
    return one.where("segment = 0").select("node", F.col("vec_id").alias("translation"), norm2(F.col("embedding"), DIMS).alias("norm2"))


def reverse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, c, _ = _edges(spark, sf_dir)
    return layers.reverse_links(edges, c).select("node", "source", "dist", F.col("pos").cast("bigint").alias("pos"))


def foreign_link_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, c, _ = _edges(spark, sf_dir)
    return layers.foreign_links(edges, layers.reverse_links(edges, c), c).select("node", F.col("slot").cast("bigint").alias("slot"), "neighbor")


def link_overflow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, c, _ = _edges(spark, sf_dir)
    return layers.link_overflow(layers.reverse_links(edges, c), c)


def _judged(source, truth_k: int, k: int, strict: bool = False):
    """Metrics of a search that sees only even ids, against the truth over all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = source(spark, sf_dir)
        q = asked(b)
        # The evaluator reads both several times.
        truth = brute_force(b, q, truth_k).persist()
        found = brute_force(b.where("vec_id % 2 = 0"), q, k).persist()
        out = Evaluator(truth, k, b, q.withColumnRenamed("vec_id", "q_id"), "euclidean", strict).evaluate_results(found)
        return out.select(F.col("k_query").cast("bigint").alias("k_query"), *[F.round(c, 9).alias(c) for c in out.columns if c != "k_query"])

    return run


def _ends(source, truth_k: int, k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = source(spark, sf_dir)
        truth = brute_force(b, asked(b), truth_k).withColumn("dist", F.sqrt("dist"))
        return duplicate_ends(truth, k).select("q_id", F.col("top1_end").cast("bigint").alias("top1_end"), F.col("topk_end").cast("bigint").alias("topk_end"))

    return run


def wide_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a query; ids joined by commas."""
    b = base(spark, sf_dir)
    return wide_results(brute_force(b, asked(b), K)).select("q_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of the query's own label: predicates come before the search."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _result(brute_force(e, asked(e), K, by="label"))


def _index(spark: SparkSession, sf_dir: str, measure: str, shard: int = ANN_SHARD, k_build: int = K_BUILD) -> tuple[VectorIndex, DataFrame]:
    b = base(spark, sf_dir)
    return VectorIndex(spark, EngineConfig(shard_size=shard)).set_base(b).build(k_build, 0.5, measure=measure), asked(b)


def ann_query_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir, "euclidean")
    return index.query(q, K, 0.64, 400)


def ann_query_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir, "cosine")
    return index.query(q, K, 0.64, 400)


def ann_query_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir, "euclidean", 256, 10)
    return index.query(q, K, 0.64, 400, merge=False)


def ann_build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _index(spark, sf_dir, "euclidean")
    return index.graph(None)


def ann_store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph stored, loaded by a second index and queried."""
    index, q = _index(spark, sf_dir, "euclidean")
    path = index.store(scratch_path(spark, "graph"))
    other = VectorIndex(spark, index.config).set_base(base(spark, sf_dir)).load(K_BUILD, path)
    return other.query(q, K, 0.64, 400)


def ann_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search so wide that it is exact: a large slack, the most iterations, more results than are kept."""
    index, q = _index(spark, sf_dir, "euclidean")
    return _result(index.query(q, 20 * K, 20.0, MAX_ITERATIONS, keep=K))


def ann_exhaustive_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _index(spark, sf_dir, "cosine")
    return _result(index.query(q, 20 * K, 20.0, MAX_ITERATIONS, keep=K))


def ann_exhaustive_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard searched so, the results merged."""
    index, q = _index(spark, sf_dir, "euclidean", 256, 10)
    return _result(index.query(q, 20 * K, 20.0, MAX_ITERATIONS, keep=K))


def ann_distance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such a search computes each point's distance at most once, and those of a quarter of the points at least."""
    index, q = _index(spark, sf_dir, "euclidean")
    n = index.base.count()
    per = index.distance_counts(q, 20 * K, 20.0, MAX_ITERATIONS).groupBy("q_id").agg(F.sum("n_distances").alias("n"))
    return per.select("q_id", ((F.col("n") <= n) & (4 * F.col("n") >= n)).alias("in_bounds"))


def ann_start_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where searches start: the base ids of the top layer."""
    index = VectorIndex(spark).set_base(base(spark, sf_dir)).build(K_BUILD, 0.5, 0)
    return index.start_points().select(F.col("node_id").cast("bigint").alias("node"), F.col("vec_id").alias("translation"))


def ann_nn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest nearest distance of a refined index of one shard: what its last merge finds if it misses nothing."""
    index = VectorIndex(spark).set_base(base(spark, sf_dir)).build(K_BUILD, 2.0, 2)
    return index.nn1_stats().select(F.round("nn1_mean", 6).alias("nn1_mean"), F.round("nn1_max", 6).alias("nn1_max"))


def ann_store_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a stored and loaded graph lacks or has beyond the built one, and whether there are any."""
    index, _ = _index(spark, sf_dir, "euclidean")
    path = index.store(scratch_path(spark, "graph"))
    other = VectorIndex(spark, index.config).set_base(base(spark, sf_dir)).load(K_BUILD, path)
    names = ["shard_id", "layer", "node_id", "vec_id", "neighbors", "selection", "translation"]
    built, loaded = index.graph(None).select(*names), other.graph(None).select(*names)
    return spark.range(1).select(F.lit(built.exceptAll(loaded).count()).cast("bigint").alias("missing"), F.lit(loaded.exceptAll(built).count()).cast("bigint").alias("extra"), F.lit(loaded.count() > 0).alias("filled"))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each kind of index finds nine of ten true neighbours at tau 0.64: recall c@10 over all queries."""
    b = base(spark, sf_dir)
    rows = []
    for name, search in (("cosine", ann_query_cosine), ("euclidean", ann_query_l2), ("loaded", ann_store_load), ("sharded", ann_query_sharded)):
        found = search(spark, sf_dir)
        found = (top_k(found.select("q_id", "vec_id", "dist"), K) if name == "sharded" else found).persist()
        truth = brute_force(b, asked(b), K, "cosine" if name == "cosine" else "euclidean").persist()
        share = Evaluator(truth, K).evaluate_results(found).head()["c_k_query"]
        found.unpersist()
        truth.unpersist()
        log.info("recall of %s: %.4f", name, share)
        rows.append((name, share >= 0.9))
    return spark.createDataFrame(rows, "setting string, reached boolean")


def shard_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a shard that fit in 1 to 64 MB, by the table's dimensions."""
    dims = base(spark, sf_dir).agg(F.max(F.size("embedding"))).head()[0]
    rows = [(m, shard_bytes(n := shard_size_for(m << 20, dims, K_BUILD), dims, K_BUILD) <= (m << 20) * 7 // 8 < shard_bytes(n + 64, dims, K_BUILD)) for m in (1, 4, 16, 64)]
    return spark.createDataFrame(rows, "megabytes bigint, fits boolean")


def vecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written as fvecs and read back: ids, first components and norms."""
    path = f"{scratch_path(spark, 'vecs')}/{uuid.uuid4().hex}.fvecs"
    write_vecs(base(spark, sf_dir), path)
    return read_vecs(spark, path).select("vec_id", F.size("embedding").cast("bigint").alias("dims"), norm2(F.col("embedding"), DIMS).alias("norm2"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


QUERIES = {
    "bf_knn_l2": _bf("euclidean"), "bf_knn_cosine": _bf("cosine"), "bf_knn_uint8_l2": _bf("euclidean", source=byte_base), "bf_knn_l2_k100": _bf("euclidean", 100),
    "bf_knn_ties": _bf("euclidean", source=tie_base), "bf_knn_l2_sql": _bf("euclidean", strategy="sql", dims=DIMS), "bf_knn_cosine_sql": _bf("cosine", strategy="sql", dims=DIMS),
    "pairwise_l2": pairwise_l2, "vector_norms": vector_norms, "half_point_distance": half_point_distance, "base_row_range": base_row_range, "sql_functions": sql_functions, "knn_table_function": knn_table_function,
    "sharded_partial_topk": sharded_partial_topk, "sharded_merge_topk": sharded_merge_topk, "sharded_unmerged": sharded_unmerged,
    "graph_config_layers": graph_config_layers, "segment_assignment": segment_assignment, "ancestor_segment": ancestor_segment, "segment_knn_graph": segment_knn_graph,
    "segment_nn1": segment_nn1, "nn1_stats": nn1_stats, "xi_values": xi_values, "layer_selection": layer_selection, "layer_translation": layer_translation, "start_points": start_points,
    "reverse_links": reverse_links, "foreign_link_merge": foreign_link_merge, "link_overflow_stats": link_overflow_stats,
    "gt_duplicate_ends": _ends(base, 20, K), "gt_duplicate_ends_ties": _ends(tie_base, 30, K), "eval_metrics": _judged(base, 20, K), "eval_metrics_dup": _judged(tie_base, 30, K), "eval_metrics_strict": _judged(tie_base, 30, K, True),
    "wide_knn": wide_knn, "filtered_knn": filtered_knn, "vecs_round_trip": vecs_round_trip,
    "ann_query_l2": ann_query_l2, "ann_query_cosine": ann_query_cosine, "ann_query_sharded": ann_query_sharded, "ann_build_graph": ann_build_graph, "ann_store_load": ann_store_load,
    "ann_exhaustive": ann_exhaustive, "ann_exhaustive_cosine": ann_exhaustive_cosine, "ann_exhaustive_sharded": ann_exhaustive_sharded, "ann_distance_counts": ann_distance_counts, "ann_start_points": ann_start_points,
    "ann_nn1": ann_nn1, "ann_store_equal": ann_store_equal, "ann_recall": ann_recall, "shard_sizing": shard_sizing,
}


# The same in DuckDB: sums run over the dimensions from left to right in doubles.
def _fold(a: str, b: str, term: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda x: {term}), lambda s, x: s + x)"


def _l2(a: str, b: str) -> str:
    return _fold(a, b, "(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)")


def _dot(a: str, b: str) -> str:
    return _fold(a, b, "x[1]::DOUBLE * x[2]::DOUBLE")


def _cos(a: str, b: str) -> str:
    norms = f"({_dot(a, a)} * {_dot(b, b)})"
    return f"CASE WHEN {norms} > 0 THEN abs(1 - {_dot(a, b)} / sqrt({norms})) ELSE 1.0::DOUBLE END"


_BYTES = "(SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 1) * 127.5::DOUBLE)))::SMALLINT) AS embedding FROM embeddings)"
_TIES = "(SELECT p_partkey AS vec_id, [p_size::DOUBLE, floor(p_retailprice / 10)::DOUBLE] AS embedding FROM part)"


def _knn_sql(dist=_l2, k: int = K, source: str = "embeddings", where: str = "TRUE") -> str:
    return (
        "SELECT q_id, vec_id, dist, rk FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rk FROM ("
        f"SELECT q.vec_id AS q_id, b.vec_id AS vec_id, {dist('q.embedding', 'b.embedding')} AS dist FROM {source} q, {source} b WHERE q.vec_id % {EVERY} = 0 AND {where})) WHERE rk <= {k}"
    )


_SHARDED = (
    "SELECT q_id, shard_id, vec_id, dist, rk FROM (SELECT *, row_number() OVER (PARTITION BY q_id, shard_id ORDER BY dist, vec_id) AS rk FROM ("
    f"SELECT q.vec_id AS q_id, b.vec_id // {SHARD} AS shard_id, b.vec_id AS vec_id, {_l2('q.embedding', 'b.embedding')} AS dist FROM embeddings q, embeddings b WHERE q.vec_id % {EVERY} = 0)) WHERE rk <= {K}"
)
_CONFIG = (
    "size AS (SELECT count(*) AS n, floor(pow(count(*) / 32.0::DOUBLE, 1 / 3.0::DOUBLE))::BIGINT AS f FROM embeddings), "
    "bottom AS (SELECT *, n / pow(f, 3)::DOUBLE AS s0f, n / pow(f + 1, 3)::DOUBLE AS s0c FROM size), "
    f"growth AS (SELECT n, CASE WHEN floor(s0c) < {K_BUILD} OR abs(s0f - 32) < abs(s0c - 32) THEN f ELSE f + 1 END AS g FROM bottom), "
    "cfg AS (SELECT n, g, 32::BIGINT AS s, n // (g * g * g) AS s0, n - g * g * g * (n // (g * g * g)) AS s0_off, 32 // g AS sg, 32 - 32 // g * g AS sg_off FROM growth), "
    "pts AS (SELECT vec_id AS node, vec_id, embedding, CASE WHEN vec_id < s0_off * (s0 + 1) THEN vec_id // (s0 + 1) ELSE (vec_id - s0_off) // s0 END AS segment FROM embeddings, cfg)"
)


def _edge_sql(points: str = "pts", name: str = "edges") -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY dist, neighbor) AS rk FROM (SELECT a.node AS node, a.segment AS segment, b.node AS neighbor, "
        f"{_l2('a.embedding', 'b.embedding')} AS dist FROM {points} a JOIN {points} b ON a.segment = b.segment AND a.node <> b.node)) WHERE rk <= {K_BUILD})"
    )


def _select_sql(edges: str, layer: int, name: str) -> str:
    return (
        f"{name} AS (SELECT segment // g * s + segment % g * sg + least(segment % g, sg_off) + pos AS node, node AS selection FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY "
        f"-ln(((node * 2654435761 + {(layer + 1) * 40503}) % 4294967296 + 1) / 4294967296.0::DOUBLE) / (sqrt(dist) + pow(2.0::DOUBLE, -23)) DESC, node) - 1 AS pos FROM {edges} WHERE rk = 2), cfg "
        "WHERE pos < sg + CASE WHEN segment % g < sg_off THEN 1 ELSE 0 END)"
    )


_GRAPH = f"WITH {_CONFIG}, {_edge_sql()}"
_ONE = f"{_GRAPH}, {_select_sql('edges', 0, 'up1')}, one AS (SELECT up1.node, pts.vec_id, pts.embedding, up1.node // 32 AS segment FROM up1 JOIN pts ON pts.node = up1.selection)"
_LOCAL = f"{_GRAPH}, local AS (SELECT node, neighbor, dist FROM edges WHERE rk <= {K_BUILD - K_BUILD // 2}), asked AS (SELECT l.neighbor AS node, l.node AS source, l.dist, row_number() OVER (PARTITION BY l.neighbor ORDER BY l.dist, l.node) AS pos FROM local l WHERE NOT EXISTS (SELECT 1 FROM local m WHERE m.node = l.neighbor AND m.neighbor = l.node))"
_KF = K_BUILD // 2


def _ends_sql(source: str, truth_k: int, k: int) -> str:
    return (
        f"truth AS (SELECT q_id, vec_id, sqrt(dist) AS dist, rk - 1 AS g FROM ({_knn_sql(k=truth_k, source=source)})), marks AS (SELECT q_id, max(dist) FILTER (WHERE g = 0) AS d1, max(dist) FILTER (WHERE g = {k - 1}) AS dk, count(*) AS depth FROM truth GROUP BY q_id), "
        f"ends AS (SELECT q_id, coalesce(min(g) FILTER (WHERE g > 0 AND dist - d1 > 1e-6), any_value(depth)) AS top1_end, CASE WHEN any_value(depth) < {k} THEN any_value(depth) ELSE coalesce(min(g) FILTER (WHERE g >= {k} AND dist - dk > 1e-6), any_value(depth)) END AS topk_end FROM truth JOIN marks USING (q_id) GROUP BY q_id)"
    )


def _judge_sql(source: str, truth_k: int, k: int, strict: bool = False) -> str:
    dup = "count(DISTINCT q_id) FILTER (WHERE g < top1_end)" if strict else "count(*) FILTER (WHERE g = 0)"
    return (
        f"WITH {_ends_sql(source, truth_k, k)}, found AS ({_knn_sql(k=k, source=source, where='b.vec_id % 2 = 0')}), n AS (SELECT count(DISTINCT q_id)::DOUBLE AS n FROM found), "
        "hits AS (SELECT q_id, rk - 1 AS r, g, top1_end, topk_end FROM found JOIN truth USING (q_id, vec_id) JOIN ends USING (q_id)) "
        f"SELECT {k}::BIGINT AS k_query, round(count(*) FILTER (WHERE r = 0 AND g = 0) / any_value(n), 9) AS c1, round(count(*) FILTER (WHERE r = 0 AND g < least(top1_end, topk_end)) / any_value(n), 9) AS c1_dup, "
        f"round(count(*) FILTER (WHERE g < least({k}, topk_end)) / (any_value(n) * {k}), 9) AS c_k_query, round(count(*) FILTER (WHERE g < topk_end) / (any_value(n) * {k}), 9) AS c_k_query_dup, "
        f"round(count(*) FILTER (WHERE g = 0) / any_value(n), 9) AS r_k_query, round({dup} / any_value(n), 9) AS r_k_query_dup FROM hits, n"
    )


_NORMS = f"SELECT vec_id, len(embedding)::BIGINT AS dims, {_dot('embedding', 'embedding')} AS norm2, embedding[1]::DOUBLE AS first FROM embeddings"
_HALF = f"list_transform(list_zip(q.embedding, b.embedding), lambda x: x[1]::DOUBLE + {HALF}::DOUBLE * (x[2]::DOUBLE - x[1]::DOUBLE))"

SQL = {
    "bf_knn_l2": _knn_sql(), "bf_knn_cosine": _knn_sql(_cos), "bf_knn_uint8_l2": _knn_sql(source=_BYTES), "bf_knn_l2_k100": _knn_sql(k=100), "bf_knn_ties": _knn_sql(source=_TIES),
    "bf_knn_l2_sql": _knn_sql(), "bf_knn_cosine_sql": _knn_sql(_cos), "knn_table_function": _knn_sql(),
    "pairwise_l2": f"SELECT q.vec_id AS q_id, b.vec_id AS vec_id, sqrt({_l2('q.embedding', 'b.embedding')}) AS dist FROM embeddings q, embeddings b WHERE q.vec_id % {EVERY} = 0",
    "vector_norms": _NORMS, "vecs_round_trip": _NORMS,
    "half_point_distance": f"SELECT q_id, vec_id, {_l2('h', 'e')} AS dist FROM (SELECT q.vec_id AS q_id, b.vec_id AS vec_id, b.embedding AS e, {_HALF} AS h FROM embeddings q, embeddings b WHERE q.vec_id % {EVERY} = 0)",
    "base_row_range": "SELECT vec_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id >= 100 AND vec_id < 300",
    "sql_functions": f"SELECT vec_id, {_l2('embedding', 'embedding')} AS self_l2, {_cos('embedding', 'embedding')} AS self_cosine, {_dot('embedding', 'embedding')} AS norm2 FROM embeddings",
    "sharded_partial_topk": _SHARDED, "sharded_merge_topk": f"SELECT * FROM (SELECT q_id, vec_id, dist, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rk FROM ({_SHARDED})) WHERE rk <= {K}",
    "sharded_unmerged": f"SELECT q_id, vec_id, dist, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS rk FROM ({_SHARDED})",
    "graph_config_layers": f"WITH {_CONFIG}, l AS (SELECT unnest([0, 1, 2, 3]) AS layer), p AS (SELECT layer::BIGINT AS layer, pow(g, 3 - layer)::BIGINT AS n_segments, CASE WHEN layer = 0 THEN n ELSE pow(g, 3 - layer)::BIGINT * 32 END AS n_points, CASE WHEN layer = 0 THEN s0 ELSE 32 END AS segment_size, g AS growth, sg AS sent_up, sg_off AS sent_up_extra FROM cfg, l) SELECT layer, n_segments, n_points, coalesce(sum(n_points) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_point, segment_size, growth, sent_up, sent_up_extra FROM p",
    "segment_assignment": f"WITH {_CONFIG} SELECT vec_id, segment FROM pts",
    "ancestor_segment": f"WITH {_CONFIG} SELECT vec_id, segment // g * 32 AS top1, segment // (g * g) * 32 AS top2, segment // (g * g * g) * 32 AS top3 FROM pts, cfg",
    "segment_knn_graph": f"{_GRAPH} SELECT node, rk, neighbor, dist FROM edges", "segment_nn1": f"{_GRAPH} SELECT node, sqrt(dist) AS nn1 FROM edges WHERE rk = 2",
    "nn1_stats": f"{_GRAPH} SELECT round(avg(sqrt(dist)), 6) AS nn1_mean, round(max(sqrt(dist)), 6) AS nn1_max FROM edges WHERE rk = 2",
    "xi_values": f"{_GRAPH} SELECT round(pow(avg(sqrt(dist)) * 0.5, 2), 6) AS xi_build, round(pow(max(sqrt(dist)) * 0.64, 2), 6) AS xi_query FROM edges WHERE rk = 2",
    "layer_selection": f"{_GRAPH}, {_select_sql('edges', 0, 'up1')} SELECT node, selection FROM up1",
    "layer_translation": f"{_ONE}, {_edge_sql('one', 'edges1')}, {_select_sql('edges1', 1, 'up2')} SELECT up2.node, selection, one.vec_id AS translation FROM up2 JOIN one ON one.node = up2.selection",
    "start_points": f"{_ONE} SELECT node, vec_id AS translation, {_dot('embedding', 'embedding')} AS norm2 FROM one WHERE segment = 0",
    "reverse_links": f"{_LOCAL} SELECT node, source, dist, pos FROM asked",
    "foreign_link_merge": f"{_LOCAL}, want AS (SELECT node, source AS neighbor, 0 AS kind, pos FROM asked WHERE pos <= {_KF} UNION ALL SELECT node, neighbor, 1, rk FROM edges e WHERE rk > {K_BUILD - _KF} AND NOT EXISTS (SELECT 1 FROM asked a WHERE a.node = e.node AND a.source = e.neighbor AND a.pos <= {_KF})), ranked AS (SELECT node, neighbor, row_number() OVER (PARTITION BY node ORDER BY kind, pos) - 1 AS slot FROM want), slots AS (SELECT vec_id AS node, unnest(range({_KF})) AS slot FROM embeddings) SELECT s.node, s.slot, coalesce(r.neighbor, s.node) AS neighbor FROM slots s LEFT JOIN ranked r ON r.node = s.node AND r.slot = s.slot",
    "link_overflow_stats": f"{_LOCAL}, per AS (SELECT node, count(*) AS n FROM asked GROUP BY node) SELECT count(*) FILTER (WHERE n > {_KF}) AS n_overflow, coalesce(sum(least(n, {_KF})), 0)::BIGINT AS n_added FROM per",
    "gt_duplicate_ends": f"WITH {_ends_sql('embeddings', 20, K)} SELECT q_id, top1_end, topk_end FROM ends", "gt_duplicate_ends_ties": f"WITH {_ends_sql(_TIES, 30, K)} SELECT q_id, top1_end, topk_end FROM ends",
    "eval_metrics": _judge_sql("embeddings", 20, K), "eval_metrics_dup": _judge_sql(_TIES, 30, K), "eval_metrics_strict": _judge_sql(_TIES, 30, K, True),
    "wide_knn": f"SELECT q_id, string_agg(vec_id::VARCHAR, ',' ORDER BY rk) AS ids FROM ({_knn_sql()}) GROUP BY q_id",
    "filtered_knn": _knn_sql(where="q.label = b.label"),
    "ann_exhaustive": _knn_sql(), "ann_exhaustive_cosine": _knn_sql(_cos), "ann_exhaustive_sharded": _knn_sql(),
    "ann_distance_counts": f"SELECT vec_id AS q_id, true AS in_bounds FROM embeddings WHERE vec_id % {EVERY} = 0",
    "ann_start_points": f"{_ONE}, {_edge_sql('one', 'edges1')}, {_select_sql('edges1', 1, 'up2')}, two AS (SELECT up2.node, one.vec_id, one.embedding, up2.node // 32 AS segment FROM up2 JOIN one ON one.node = up2.selection), {_edge_sql('two', 'edges2')}, {_select_sql('edges2', 2, 'up3')} SELECT up3.node, two.vec_id AS translation FROM up3 JOIN two ON two.node = up3.selection",
    "ann_nn1": f"SELECT round(avg(d), 6) AS nn1_mean, round(max(d), 6) AS nn1_max FROM (SELECT min(d) AS d FROM (SELECT a.vec_id, sqrt({_l2('a.embedding', 'b.embedding')}) AS d FROM embeddings a, embeddings b) WHERE d > 0 GROUP BY vec_id)",
    "ann_store_equal": "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, true AS filled",
    "ann_recall": "SELECT unnest(['cosine', 'euclidean', 'loaded', 'sharded']) AS setting, true AS reached",
    "shard_sizing": "SELECT unnest([1, 4, 16, 64])::BIGINT AS megabytes, true AS fits",
}
__all__ = ["QUERIES", "SQL", "Measure"]
