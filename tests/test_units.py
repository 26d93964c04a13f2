"""Sizes, distances, kernel and evaluator on hand-made inputs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knnspark.operators.exact import nearest, pair_distances
from knnspark.operators.kernel import Builder, Space, search_shard
from knnspark.plans.graph_config import GraphConfig, search_sizes
from knnspark.types import EngineConfig, Measure, check_build, check_query

EUCLIDEAN, COSINE = Measure.EUCLIDEAN, Measure.COSINE


@pytest.mark.parametrize(
    ("n", "k", "want"),
    [
        (500, 24, (12, 32, 2, 62, 4, 16, 0)), (2000, 24, (12, 32, 4, 31, 16, 8, 0)), (500, 10, (5, 32, 3, 18, 14, 10, 2)),
        (10_000, 24, (12, 32, 7, 29, 53, 4, 4)), (25_000, 24, (12, 32, 9, 34, 214, 3, 5)), (1_000_000, 24, (12, 32, 32, 30, 16_960, 1, 0)),
    ],
)
def test_graph_config(n, k, want):
    c = GraphConfig.derive(n, k)
    assert (c.kf, c.s, c.g, c.s0, c.s0_off, c.sg, c.sg_off) == want
    assert c.s0 * c.g**3 + c.s0_off == n and c.sg * c.g + c.sg_off == c.s
    assert c.points[0] == n and c.points[3] == c.s
    ids = np.arange(n)
    for segment in (0, c.segments[0] // 2, c.segments[0] - 1):
        a, b = c.bounds(0, segment)
        assert (c.segment_of(0, ids[a:b]) == segment).all()


def test_config_limits():
    with pytest.raises(ValueError, match="too few"):
        GraphConfig.derive(20, 24)
    for bad in ((1, 0.5, 2), (600, 0.5, 2), (24, -1, 2), (24, 0.5, -1)):
        with pytest.raises(ValueError):
            check_build(*bad)
    for bad in ((0, 0.1, 10), (6001, 0.1, 10), (10, -0.1, 10), (10, 0.1, 0), (10, 0.1, 9000)):
        with pytest.raises(ValueError):
            check_query(*bad)
    with pytest.raises(ValueError):
        Measure.of("manhattan")
    with pytest.raises(ValueError):
        EngineConfig(shard_size=0)
    assert search_sizes(10, 400) == (32, 512) and search_sizes(10, 200) == (64, 256)


def test_distances():
    a, b = np.array([[0.0, 0.0], [3.0, 4.0], [1.0, 0.0]]), np.array([[1.0, 1.0], [3.0, 4.0], [-1.0, 0.0]])
    assert pair_distances(a, b, EUCLIDEAN).tolist() == [2.0, 0.0, 4.0]
    assert pair_distances(a, b, COSINE).tolist() == [1.0, 0.0, 2.0]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.integers(1, 7), st.integers(1, 12), st.integers(0, 1), st.integers(0, 10**6))
def test_nearest_is_brute_force(n, d, k, cosine, seed):
    rng = np.random.default_rng(seed)
    base, queries = rng.integers(0, 4, (n, d)).astype(float), rng.integers(0, 4, (5, d)).astype(float)
    measure = COSINE if cosine else EUCLIDEAN
    row, ids, dist = nearest(queries, base, np.arange(n), k, measure)
    for q in range(5):
        want = sorted(zip(pair_distances(np.repeat(queries[q : q + 1], n, 0), base, measure).tolist(), range(n), strict=True))[:k]
        assert list(zip(dist[row == q].tolist(), ids[row == q].tolist(), strict=True)) == want


def test_nan_never_matches():
    base = np.array([[0.0, 1.0], [math.nan, 0.0]])
    _, ids, _ = nearest(np.array([[0.0, 0.0]]), base, np.array([5, 6]), 10, EUCLIDEAN)
    assert ids.tolist() == [5]


@pytest.mark.parametrize("measure", [EUCLIDEAN, COSINE])
def test_graph_recall(measure):
    rng = np.random.default_rng(3)
    x = rng.random((400, 16))
    g = Builder(x, measure, 10, 0.5, 1).build()
    assert [len(e) for e in g.neighbors] == list(g.config.points)
    for layer, edges in enumerate(g.neighbors):
        assert ((edges >= 0) & (edges < g.config.points[layer])).all()
    again = Builder(x, measure, 10, 0.5, 1).build()
    assert all((a == b).all() for a, b in zip(g.neighbors, again.neighbors, strict=True))
    queries = rng.random((50, 16))
    row, ids, dist = search_shard(Space(x, measure), g.neighbors[0], g.translation[3], g.nn1[1], queries, 10, 0.64, 400)
    trow, tids, tdist = nearest(queries, x, np.arange(400), 10, measure)
    hits = sum(len(set(ids[row == q]) & set(tids[trow == q])) for q in range(50))
    assert hits >= 450
    assert np.allclose(dist, pair_distances(queries[row], x[ids], measure))
    for q in range(50):
        assert len(set(ids[row == q])) == (row == q).sum() and (np.diff(dist[row == q]) >= 0).all()


def test_wide_search_is_exact():
    rng = np.random.default_rng(4)
    x = rng.random((200, 4))
    g = Builder(x, EUCLIDEAN, 12, 0.5, 1).build()
    q = rng.random((20, 4))
    _, ids, _ = search_shard(Space(x, EUCLIDEAN), g.neighbors[0], g.translation[3], 10.0, q, 5, 10.0, 400)
    assert (ids == nearest(q, x, np.arange(200), 5, EUCLIDEAN)[1]).mean() > 0.99
