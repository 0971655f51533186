"""Exponion search and the rounds against plain assignment in exact integers."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrivium.llm import centroids


def plain(x, c):
    """Nearest centroid by all distances, in Python integers; the smallest number of equal ones."""
    return [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), k) for k, w in enumerate(c)) for v in x]


def lloyd(rows, k, rounds, scale, seed="1"):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in first]
    for _ in range(rounds):
        at = plain([v for _, v in kept], c)
        for n in range(len(c)):
            own = [v for (_, v), (_, m) in zip(kept, at) if m == n]
            c[n] = [sum(col) // len(own) for col in zip(*own)] if own else c[n]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, plain([v for _, v in kept], c))], c


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.integers(1, 4), st.sampled_from([2, 5, 200, 2**27 - 1]))
def test_search_keeps_ties_over_moving_centroids(seed, k, dims, span):
    """Small spans give many equal distances and equal centroids; the bounds carry over several moves."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-span, span + 1, (60, dims)), rng.integers(-span, span + 1, (k, dims))
    at, upper, lower, moved = np.zeros(60, np.int64), np.full(60, np.inf), np.zeros(60), np.zeros(k)
    for _ in range(5):
        at, upper, lower, _ = centroids.search(x, at, upper, lower, centroids.Model(c, moved))
        assert at.tolist() == [n for _, n in plain(x, c)]
        new = c + rng.integers(-2, 3, c.shape) * rng.integers(0, 2, (k, 1))
        new = np.clip(new, -(2**27 - 1), 2**27 - 1)
        step = (new - c).astype(float)
        c, moved = new, np.sqrt((step * step).sum(1)) * (1 + centroids.SLACK)


def test_search_scans_a_ball_only():
    """Once clusters are apart, settled rows compute nothing and others few of the centroids."""
    rng = np.random.default_rng(1)
    c = rng.integers(-(10**6), 10**6, (64, 8))
    x = np.repeat(c, 50, axis=0) + rng.integers(-50, 51, (3200, 8))
    at, upper, lower, first = centroids.search(x, np.zeros(3200, np.int64), np.full(3200, np.inf), np.zeros(3200), centroids.Model(c, np.zeros(64)))
    moved = np.full(64, 3.0)
    _, _, _, again = centroids.search(x, at, upper, lower, centroids.Model(c, moved))
    assert first <= 3200 * 65 and again == 0


@pytest.mark.parametrize("k", [1, 3, 16, 400])
def test_rounds_against_plain(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.integers(-6, 7, 3) / 4]) for i in range(150)] + [(i, [0.25, 0.25, 0.25]) for i in range(500, 580)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out, c = centroids.clusters(frame, k=k, rounds=3, dims=3, scale=4.0)
    want, cs = lloyd(rows, k, 3, 4.0)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and c.tolist() == cs


def test_edges(spark):
    good = [0.5, -0.25]
    rows = [(1, good), (1, good), (1, [0.5, 0.75]), (None, good), (2, None), (3, []), (4, [0.5]), (5, [0.5, None]), (6, [0.5, float("nan")]), (7, [float("-inf"), 0.0]), (2**53 + 1, [9.0, 9.0])]
    clash = {n: F.lit("x") for n in ("id", "at", "upper", "lower", "vector", "cluster", "distance")}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clash)
    out, c = centroids.clusters(frame, k=2, dims=2, rounds=2, scale=64.0)
    want, cs = lloyd([(i, v) for i, v in rows if v and len(v) == 2 and all(x is not None and np.isfinite(x) for x in v)], 2, 2, 64.0)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key) and c.tolist() == cs
    out, c = centroids.clusters(frame.where("false"), dims=2)
    assert out.columns == ["vec_id", "cluster", "distance"] and out.collect() == [] and c.shape == (0, 2)
    with pytest.raises(Exception, match="after scaling"):
        centroids.clusters(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), dims=2)
