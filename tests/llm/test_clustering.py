"""Exact centroid rounds against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from tracewell.llm import clustering as C

SCHEMA = "vec_id long, embedding array<float>, cluster int"


def plain_nearest(centroids, point):
    return min((sum((a - b) ** 2 for a, b in zip(c, point)), k) for k, c in enumerate(centroids))


def plain(rows, k=16, rounds=3, d=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) with whole numbers of any size."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [p for _, p in order[:k]]
    for _ in range(rounds):
        of = [plain_nearest(centroids, p)[1] for _, p in kept]
        for c in set(of):
            members = [p for (_, p), at in zip(kept, of) if at == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    near = [plain_nearest(centroids, p) for _, p in kept]
    inertia = {c: sum(n for n, at in near if at == c) for _, c in near}
    return sorted(((i, c, n, inertia[c], sum(inertia.values()), centroids[c]) for (i, _), (n, c) in zip(kept, near)), key=repr)


def run(spark, rows, **how):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, C.cluster(frame, **how).collect()), key=repr)


def vectors(n, seed=0, step=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (n, 64)) + rng.integers(0, 5, (n, 1))
    v = np.round(v / step) * step if step else v
    return [(i, v[i].astype(np.float32).tolist(), 0) for i in range(n)]


def test_same_as_loops(spark):
    for rows in (vectors(150), vectors(120, 1, step=2.0)):
        assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    good = vectors(30, 2)
    same = [(100 + i, good[0][1], 0) for i in range(25)] + [good[3]] * 3 + [(None, good[4][1], 0)] * 2
    bad = [(200, None, 0), (201, [], 0), (202, [1.0] * 63, 0), (203, [1.0] * 65, 0), (204, [None] + [1.0] * 63, 0), (205, [math.nan] + [1.0] * 63, 0), (206, [math.inf] + [1.0] * 63, 0)]
    rows = good + same + bad
    assert run(spark, rows) == plain(rows)
    few = good[:5] + bad
    assert run(spark, few) == plain(few) and len(run(spark, few)) == 5
    assert run(spark, bad) == [] and run(spark, []) == []


def test_all_vectors_equal(spark):
    rows = [(i, [0.5] * 64, 0) for i in range(40)]
    assert run(spark, rows) == plain(rows)
    assert {r[1] for r in run(spark, rows)} == {0}


def test_components_beyond_a_long_distance(spark):
    with pytest.raises(Exception, match="a component exceeds"):
        run(spark, [(1, [1e30] + [0.0] * 63, 0)])


@pytest.mark.parametrize("k,d,spread", [(1, 2, 9), (2, 1, 3), (5, 2, 4), (16, 64, 100), (200, 3, 12), (300, 8, 2**26), (64, 1, 1)])
def test_tree_finds_the_nearest(k, d, spread):
    rng = np.random.default_rng(k)
    centroids, points = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-spread, spread + 1, (500, d))
    tree = C.VantageTree(centroids)
    number, distance = tree.nearest(points)
    every = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def test_tree_prunes():
    """Far clusters are never opened: the leaves looked at are few."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(0, 1 << 20, (512, 2))
    points = centroids[rng.integers(0, 512, 200)] + rng.integers(-50, 50, (200, 2))
    looked = []
    squared = C._squared
    try:
        tree = C.VantageTree(centroids)
        C._squared = lambda p, c: looked.append(len(p)) or squared(p, c)
        tree.nearest(points)
    finally:
        C._squared = squared
    assert sum(looked) < 200 * 512 / 4


def test_search_in_small_steps(monkeypatch):
    rng = np.random.default_rng(3)
    centroids, points = rng.integers(0, 50, (40, 3)), rng.integers(0, 50, (300, 3))
    whole = C.VantageTree(centroids).nearest(points)
    monkeypatch.setattr(C, "_OPEN", 100)
    part = C.VantageTree(centroids).nearest(points)
    assert all((a == b).all() for a, b in zip(whole, part))
