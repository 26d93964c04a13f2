"""DataFrame operators, index, sources, evaluator and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnspark import EngineConfig, Evaluator, VectorIndex, brute_force, from_numpy, read_vecs, write_vecs
from knnspark.functions.distance import register_functions
from knnspark.operators import sharding
from knnspark.operators.evaluate import describe, duplicate_ends
from knnspark.operators.index import iter_results
from knnspark.plans.sizing import shard_bytes, shard_size_for, worker_memory
from knnspark.plans.sweep import ground_truth, main, sweep
from knnspark.sources import hdf5
from knnspark.streaming.queries import stream_queries


@pytest.fixture(scope="module")
def base(spark):
    return from_numpy(spark, np.random.default_rng(1).random((300, 8)).astype(np.float32)).persist()


def rows(df):
    return sorted(map(tuple, df.select("q_id", "rk", "vec_id", "dist").collect()))


def test_strategies_agree(spark, base):
    q = base.where("vec_id % 20 = 0")
    for measure in ("euclidean", "cosine"):
        want = rows(brute_force(base, q, 7, measure))
        assert len(want) == 15 * 7
        assert rows(brute_force(base, q, 7, measure, strategy="sql", dims=8)) == want
        assert rows(brute_force(base, q, 7, measure, strategy="sql")) == want
        assert rows(brute_force(base, q, 7, measure, query_block=4)) == want
        assert rows(brute_force(base.repartition(5), q, 7, measure)) == want


def test_queries_in_groups_and_shards(spark, base):
    marked = base.withColumn("label", F.when(F.col("vec_id") % 7 < 6, F.col("vec_id") % 7))
    q = marked.where("vec_id % 20 = 0")
    some = marked.where("label = 3").select("vec_id", "embedding")
    for block in (4096, 4):
        found = brute_force(marked, q, 5, by="label", query_block=block)
        assert found.join(marked.select("vec_id", F.col("label").alias("a")), "vec_id").join(marked.select(F.col("vec_id").alias("q_id"), F.col("label").alias("b")), "q_id").where("NOT a <=> b").count() == 0
        assert rows(found.where("q_id % 7 = 3")) == rows(brute_force(some, q.where("label = 3"), 5)) and found.where("q_id % 7 = 6").count() == 0
        assert rows(found) == rows(brute_force(marked, q, 5, by="label", strategy="sql"))
        split = brute_force(marked, q, 4, shard_size=70, query_block=block)
        pairs = brute_force(base, q, 300).drop("rk").withColumn("shard_id", sharding.shard_of(F.col("vec_id"), 70))
        want = sharding.shard_top_k(pairs, 4)
        assert sorted(map(tuple, split.select("q_id", "shard_id", "rk", "vec_id", "dist").collect())) == sorted(map(tuple, want.select("q_id", "shard_id", "rk", "vec_id", "dist").collect()))
    with pytest.raises(ValueError):
        brute_force(marked, q, 5, by="label", shard_size=70)
    with pytest.raises(Exception, match="dimensions"):
        wide = spark.range(2).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(1.0), 4097).alias("embedding"))
        brute_force(wide, wide, 1).count()


def test_edge_rows(spark):
    data = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [math.nan, 1.0]), (5, [3.0, 4.0])]
    b = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    q = b.where("vec_id = 1")
    for strategy in ("arrow", "sql"):
        assert rows(brute_force(b, q, 10, strategy=strategy)) == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (1, 3, 5, 25.0)]
        assert [r[3] for r in rows(brute_force(b, q, 10, "cosine", strategy=strategy))] == [1.0, 1.0, 1.0]
        assert rows(brute_force(b, q.where("false"), 10, strategy=strategy)) == []
        assert rows(brute_force(b.where("false"), q, 10, strategy=strategy)) == []


def test_sharded_is_unsharded(spark, base):
    q = base.where("vec_id % 20 = 0")
    pairs = brute_force(base, q, 300).drop("rk").withColumn("shard_id", sharding.shard_of(F.col("vec_id"), 70))
    assert rows(sharding.merge_top_k(sharding.shard_top_k(pairs, 5), 5)) == rows(brute_force(base, q, 5))
    with pytest.raises(ValueError, match="no multiple"):
        sharding.with_shards(base, 70, strict=True)


def test_index(spark, base, tmp_path):
    q = base.where("vec_id % 20 = 0")
    index = VectorIndex(spark, EngineConfig(shard_size=150)).set_base(base)
    with pytest.raises(ValueError, match="build or load"):
        index.query(q)
    index.build(10, 0.5, 1)
    with pytest.raises(ValueError, match="already"):
        index.build(10)
    truth = index.bf_query(q, 20)
    found = index.query(q, 5, 0.64, 400)
    asked = q.withColumnRenamed("vec_id", "q_id")
    metrics = Evaluator(truth, 5, base, asked).evaluate_results(found)
    row = metrics.head()
    assert row["c1"] >= 0.95 and row["c_k_query"] >= 0.9 and "c@5" in describe(metrics)
    assert index.query(q, 5, 0.64, 400, merge=False).groupBy("q_id").count().where("count <> 10").count() == 0
    path = index.store(f"file://{tmp_path}/index")
    other = VectorIndex(spark, index.config).set_base(base).load(10, path)
    assert rows(other.query(q, 5, 0.64, 400)) == rows(found)
    assert other.graph(1).where("layer = 0").count() == 150 and index.nn1_stats().count() == 2
    with pytest.raises(ValueError, match="does not fit"):
        VectorIndex(spark, index.config).set_base(base.where("vec_id < 200")).load(10, path)
    with pytest.raises(ValueError, match="built for"):
        other.query(q, 5, measure="cosine")
    wide = list(iter_results(found))
    assert len(wide) == 15 and all(len(ids) == 5 for _, ids, _ in wide)
    table = sweep(other, q, ground_truth(other, q, 20, "euclidean"), 5, (0.3, 0.64), 200)
    assert table.count() == 2


def test_index_with_many_query_blocks(spark, base):
    q = base.where("vec_id % 20 = 0")
    index = VectorIndex(spark, EngineConfig(shard_size=150)).set_base(base).build(10, 0.5, 0)
    other = VectorIndex(spark, EngineConfig(shard_size=150, query_block=4)).set_base(base)
    other._graph, other.params = index._graph, index.params
    assert rows(other.query(q, 5)) == rows(index.query(q, 5))
    assert other.query(q, 5, merge=False).count() == 15 * 2 * 5
    counts = other.distance_counts(q, 5)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, index.distance_counts(q, 5).collect()))
    assert counts.count() == 30 and counts.where("n_distances < 5 OR n_distances > 150").count() == 0


def test_small_shard_at_the_switch(spark, base):
    """A shard with just enough points for segments has a graph; with one fewer it is searched exactly. Both find all there is to find."""
    for n in (31, 32, 33):
        few = base.where(F.col("vec_id") < n)
        index = VectorIndex(spark).set_base(few).build(10, 0.5, 1)
        assert rows(index.query(few, 5, 5.0, 400)) == rows(brute_force(few, few, 5))
        assert index.graph().where("layer > 0").isEmpty() == (n < 32)


def test_small_shard_is_searched_exactly(spark, base):
    few = base.where("vec_id < 10")
    index = VectorIndex(spark).set_base(few).build(10, 0.5, 0)
    assert rows(index.query(few, 3)) == rows(brute_force(few, few, 3))


def test_evaluator_by_hand(spark):
    truth = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 20), (2, 2, 21), (2, 3, 22)], "q_id bigint, rk int, vec_id bigint")
    found = spark.createDataFrame([(1, 1, 11), (1, 2, 10), (2, 1, 20), (2, 2, 99)], "q_id bigint, rk int, vec_id bigint")
    row = Evaluator(truth, 2).evaluate_results(found).head()
    assert (row["c1"], row["c_k_query"], row["r_k_query"]) == (0.5, 0.75, 1.0) and math.isnan(row["c1_dup"])
    missed = Evaluator(truth, 2).evaluate_results(found.where("q_id = 1")).head()
    assert (missed["c1"], missed["r_k_query"]) == (0.0, 0.5)
    with pytest.raises(ValueError, match="without ground truth"):
        Evaluator(truth.where("q_id = 1"), 2).evaluate_results(found)
    with pytest.raises(ValueError, match="ends at 3"):
        Evaluator(truth, 4).evaluate_results(found)
    at = {10: 1.0, 11: 1.0, 12: 2.0, 20: 1.0, 21: 2.0, 22: 2.0}
    b = spark.createDataFrame([(k, [v]) for k, v in at.items()] + [(99, [9.0])], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "q_id bigint, embedding array<double>")
    row = Evaluator(truth, 2, b, q).evaluate_results(found).head()
    assert (row["c1_dup"], row["c_k_query_dup"], row["r_k_query_dup"]) == (1.0, 0.75, 1.0)
    dist = truth.join(b.select("vec_id", F.col("embedding")[0].alias("dist")), "vec_id")
    assert {tuple(r) for r in duplicate_ends(dist, 2).collect()} == {(1, 2, 2), (2, 1, 3)}
    assert {r["topk_end"] for r in duplicate_ends(dist, 5).collect()} == {3}


@pytest.mark.parametrize(("kind", "dtype"), [("fvecs", np.float32), ("bvecs", np.uint8), ("ivecs", np.int32)])
def test_vecs(spark, tmp_path, kind, dtype):
    x = np.random.default_rng(2).integers(0, 256, (100, 5)).astype(dtype)
    path = f"{tmp_path}/v.{kind}"
    write_vecs(from_numpy(spark, x), path, files=3)
    back = read_vecs(spark, path).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in back] == list(range(100)) and np.array_equal([r["embedding"] for r in back], x)
    some = read_vecs(spark, path, first=30, num=20).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in some] == list(range(30, 50)) and np.array_equal([r["embedding"] for r in some], x[30:50])
    assert read_vecs(spark, path, first=90).count() == 10
    (tmp_path / f"v.{kind}" / "_try-00000-9").write_bytes(b"left")
    write_vecs(from_numpy(spark, x), path, files=2)
    assert sorted(p.name for p in (tmp_path / f"v.{kind}").iterdir() if not p.name.startswith(".")) == [f"part-0000{k}.{kind}" for k in range(2)]
    with pytest.raises(Exception, match="more than"):
        read_vecs(spark, path, first=90, num=20).count()
    one = f"{tmp_path}/one.{kind}"
    np.concatenate([np.full((100, 1), 5, "<u4").view("u1").reshape(100, 4), x.astype(dtype).view("u1").reshape(100, -1)], axis=1).tofile(one)
    assert np.array_equal([r["embedding"] for r in read_vecs(spark, one).orderBy("vec_id").collect()], x)


def test_vecs_errors(spark, tmp_path):
    with pytest.raises(Exception, match="not one of"):
        read_vecs(spark, f"{tmp_path}/x.txt").count()
    (tmp_path / "bad.fvecs").write_bytes(b"\x02\0\0\0abc")
    with pytest.raises(Exception, match="no multiple"):
        read_vecs(spark, f"{tmp_path}/bad.fvecs").count()


def test_sizing(spark):
    for memory in (1 << 16, 1 << 22, 1 << 28):
        n = shard_size_for(memory, 64, 24)
        assert n == 1 or shard_bytes(n, 64, 24) <= memory * 7 / 8
    assert shard_size_for(1 << 28, 64, 24, workers=2) < shard_size_for(1 << 28, 64, 24) and shard_size_for(1, 64) == 1
    memory, workers = worker_memory(spark)
    assert memory >= 1 << 28 and workers >= 1


def test_hdf5(spark, tmp_path):
    if hdf5.h5py is None:
        with pytest.raises(ImportError):
            hdf5.read_hdf5(spark, "x.h5")
        return
    x = np.random.default_rng(1).random((50, 4)).astype(np.float32)
    with hdf5.h5py.File(tmp_path / "x.h5", "w") as f:
        f["train"] = x
    back = hdf5.read_hdf5(spark, str(tmp_path / "x.h5"), rows_per_partition=20).orderBy("vec_id").collect()
    assert np.array_equal([r["embedding"] for r in back], x)


def test_command_line(spark, base, tmp_path, capsys):
    """Builds and stores, then loads; truth is computed once and read the second time."""
    base.write.parquet(f"{tmp_path}/base")
    base.where("vec_id % 20 = 0").write.parquet(f"{tmp_path}/query")
    arguments = ["--base", f"{tmp_path}/base", "--query", f"{tmp_path}/query", "--gt", f"{tmp_path}/truth", "--graph_dir", f"{tmp_path}/graph", "--k_build", "10", "--refinement_iterations", "0", "--shard_size", "150"]
    for _ in range(2):
        main(arguments)
        printed = capsys.readouterr().out
        assert printed.count("0.34") >= 1 and "c_k_query" in printed


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT vec_l2(array(1D, 2D), array(4D, 6D)) a, vec_cosine(array(0D), array(1D)) b, vec_norm2(array(3D, 4D)) c, vec_half(array(0D), array(10D)) d").head()
    assert (row["a"], row["b"], row["c"], row["d"]) == (25.0, 1.0, 25.0, [4.0])


def test_stream(spark, base, tmp_path):
    base.where("vec_id % 20 = 0").write.parquet(f"{tmp_path}/in")
    seen = {}
    stream = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    run = stream_queries(stream, base, lambda df, n: seen.__setitem__(n, rows(df)), f"{tmp_path}/checkpoint", 3, {"availableNow": True})
    run.awaitTermination(120)
    assert sum(seen.values(), []) == rows(brute_force(base, base.where("vec_id % 20 = 0"), 3))
