"""Centroid clustering against a plain one in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from matchloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64
            and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centers)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), centers


def made(n=300, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 64))
    rows = [(i, (middles[i % 12] + rng.normal(scale=0.3 + i % 3, size=64)).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * 64) for i in range(40)]  # one vector many times
    rows += [(7, rows[7][1]), (7, rows[8][1])]  # ids that repeat
    rows += [(None, [0.1] * 64), (2001, None), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] + [1.0] * 63),
             (2005, [1.0] * 63 + [float("-inf")]), (2006, [])]
    return rows


def run(spark, rows, **given):
    df = spark.createDataFrame([(i, v, None, "x") for i, v in rows], SCHEMA)
    found, centers = centroids.cluster_vectors(centroids.integer_vectors(df), **given)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=repr), centers.tolist()


def test_equals_plain_clustering(spark):
    rows = made()
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("k,rounds", [(1, 2), (3, 0), (16, 5)])
def test_other_sizes(spark, k, rounds):
    rows = made(60, 9)
    assert run(spark, rows, k=k, rounds=rounds) == plain(rows, k, rounds)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.25] * 64), (2, [0.25] * 64), (None, [-0.26] * 64)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, [(2001, None)]) == ([], [])


def test_ties_go_to_the_smaller_number():
    near, best, second = centroids.exact_scan(np.array([[0, 0], [5, 0]]), np.array([[1, 0], [-1, 0], [1, 0]]))
    assert near.tolist() == [0, 0] and best.tolist() == [1, 16] and second.tolist() == [1, 16]


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(2)
    middles = rng.integers(-900, 900, size=(16, 64))
    vectors = (middles[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, size=(4000, 64))).astype(np.int64)
    cluster, best, second = centroids.exact_scan(vectors, middles)
    upper, lower = np.sqrt(best.astype(float)), np.sqrt(second.astype(float))
    scanned = 0
    for step in range(4):
        moved = middles + rng.integers(-9, 9, size=middles.shape)
        cluster, upper, lower, n = centroids.Bounds(moved, middles).assign(vectors, cluster, upper, lower)
        middles, scanned = moved, scanned + n
        near, best, second = centroids.exact_scan(vectors, middles)
        assert (near == cluster).all()
        assert (upper >= np.sqrt(best.astype(float)) * (1 - 1e-12)).all() and (lower <= np.sqrt(second.astype(float))).all()
    assert scanned < 400  # of 16,000


def test_components_too_wide_are_an_error(spark):
    with pytest.raises(Exception, match="too wide"):
        run(spark, [(1, [3e7] + [0.0] * 63)])
