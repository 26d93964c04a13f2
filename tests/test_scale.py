"""What keeps searches bounded and spread over tasks: blocks, copies, shards and ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnspark import EngineConfig, VectorIndex, brute_force, from_numpy
from knnspark.operators import exact
from knnspark.operators.kernel import Builder, Ranks, Space, _searched, ranked_search, search_shard
from knnspark.types import Measure


@pytest.fixture(scope="module")
def base(spark):
    return from_numpy(spark, np.random.default_rng(1).random((300, 8)).astype(np.float32)).persist()


def rows(df):
    return sorted(map(tuple, df.select("q_id", "rk", "vec_id", "dist").collect()))


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("measure", [Measure.EUCLIDEAN, Measure.COSINE])
def test_ranks_search_as_distances_do(measure, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((300, 6))
    x[40:60] = x[60:80]
    made = Builder(x, measure, 10, 0.5, 1).build()
    space, queries, starts = Space(x, measure), rng.random((20, 6)), np.unique(made.translation[3])
    many = np.broadcast_to(starts, (20, len(starts)))
    for k, tau, width in ((5, 0.64, 32), (100, 20.0, 128)):
        counts = np.zeros(20, np.int64), np.zeros(20, np.int64)
        want = _searched(space, made.neighbors[0], starts, queries, width, k, made.nn1[1] * tau, 400, tau, counts[0])
        got = ranked_search(space, Ranks.of(space.table(queries)), made.neighbors[0], many, width, k, made.nn1[1] * tau, 400, tau, counts[1])
        assert (want[1] == got[1]).all() and np.allclose(want[0], got[0]) and (counts[0] == counts[1]).all()
    monkeypatch.setattr("knnspark.operators.kernel.TABLE", 0)
    slow = Builder(x, measure, 10, 0.5, 1).build()
    assert all((a == b).all() for a, b in zip(slow.neighbors, made.neighbors, strict=True)) and np.allclose(slow.nn1, made.nn1)
    found = search_shard(space, made.neighbors[0], starts, made.nn1[1], queries, 5, 0.64, 400)
    monkeypatch.undo()
    assert (found[1] == search_shard(space, made.neighbors[0], starts, made.nn1[1], queries, 5, 0.64, 400)[1]).all()


def test_index_spreads_shards(spark, base):
    """Adaptive execution does not join tasks by their bytes, and nothing built is broadcast; small broadcast times do no harm."""
    q = base.where("vec_id % 20 = 0")
    index = VectorIndex(spark, EngineConfig(shard_size=50, query_block=4)).set_base(base).build(10, 0.5, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(index.query(q, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" not in text and text.count("REPARTITION_BY_NUM") >= 2
    assert rows(index.query(q, 20, 5.0, 400, keep=3)) == [r for r in rows(index.query(q, 20, 5.0, 400)) if r[1] <= 3]


def test_copies_meet_once(spark, base, monkeypatch):
    """Of each vector the k least ids take part, and one query for all its copies."""
    some = base.where("vec_id < 20")
    many = spark.range(30).crossJoin(some).select((F.col("id") * 20 + F.col("vec_id")).alias("vec_id"), "embedding")
    seen, one = [], exact._one_block

    def spy(b, few, *args):
        seen.append((b.count(), len(few)))
        return one(b, few, *args)

    monkeypatch.setattr(exact, "_one_block", spy)
    found = brute_force(many, many.where("vec_id % 2 = 0"), 7)
    assert seen == [(20 * 7, 10)]
    assert rows(found) == [r for r in rows(brute_force(many, many, 7, strategy="sql")) if r[0] % 2 == 0] and found.count() == 300 * 7


def test_blocks_have_bounded_rows(spark, base, monkeypatch):
    monkeypatch.setattr(exact, "PART", 100)
    found = brute_force(base, base, 4, query_block=60)
    assert "repartition" in plan(found).lower() and rows(found) == rows(brute_force(base, base, 4))
    monkeypatch.setattr(exact, "CELLS", 50)
    assert rows(brute_force(base, base, 4)) == rows(found)


def test_shard_results_are_not_shuffled(spark, base):
    found = brute_force(base, base.where("vec_id % 20 = 0"), 4, shard_size=70)
    assert "Window" not in plan(found) and found.count() == 15 * 5 * 4


def test_all_pairs(spark, base):
    q = base.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q_id")
    got = {tuple(r) for r in exact.all_pairs(base, q, exact.block_l2, block=4).collect()}
    x = np.array([r["embedding"] for r in base.orderBy("vec_id").collect()], dtype=float)
    assert got == {(k, j, float(exact.pair_distances(x[k : k + 1], x[j : j + 1], Measure.EUCLIDEAN)[0])) for k in range(0, 300, 20) for j in range(300)}
    assert exact.uniform(base) and not exact.uniform(base.union(spark.createDataFrame([(999, [1.0])], base.schema)))


def test_start_points_without_the_graph(spark, base):
    """The top layer's points from tables are the built graph's, with ids in a row or not."""
    for some in (base, base.where("vec_id % 3 <> 1")):
        index = VectorIndex(spark).set_base(some).build(10, 0.5, 0)
        want = index.graph(None).where("layer = 3").select("shard_id", "node_id", "vec_id")
        assert sorted(map(tuple, index.start_points().collect())) == sorted(map(tuple, want.collect()))
        assert "FlatMapGroupsInArrow" not in plan(index.start_points())


def test_nearest_distances_are_exact(spark):
    """Merges miss some nearest points of 600 in 32 dimensions; copies count as many times and are not each other's nearest."""
    x = np.random.default_rng(5).standard_normal((600, 32)).astype(np.float32)
    x[7] = x[8]
    far = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    far[far == 0] = np.inf
    want = np.sqrt(far.min(1))
    row = VectorIndex(spark).set_base(from_numpy(spark, x)).build(10, 0.0, 1).nn1_stats().head()
    assert np.allclose((row["nn1_mean"], row["nn1_max"]), (want.mean(), want.max()), rtol=1e-12)
