"""Clustering against every distance in Python's numbers, the bounds against sampled points, and awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from campusflow.llm import clustering


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == i]
            if own:
                centroids[i] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {c: sum(d for _, d, o in found if o == c) for _, _, c in found}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digests[c]) for i, d, c in found), key=repr)


def result(frame):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def clouds(spark):
    """Well separated clouds of points in eight dimensions."""
    rng = random.Random(5)
    middles = [[rng.uniform(-9, 9) for _ in range(8)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in middles[i % 6]]) for i in range(400)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_against_all_distances(clouds):
    rows, frame = clouds
    for k, rounds in ((6, 3), (16, 5), (1, 2), (6, 0)):
        found = clustering.cluster_vectors(frame, k=k, rounds=rounds, dims=8)
        assert result(found) == brute(rows, k, rounds, 8)


def test_separated_clouds_are_not_compared_again(clouds):
    _, frame = clouds
    scanned = clustering.cluster_vectors(frame, k=16, rounds=6, dims=8).agg(F.avg(F.col("scanned").cast("int"))).first()[0]
    assert scanned < 0.5


def test_bounds_hold_and_are_tighter_than_the_drift():
    rng = np.random.default_rng(7)
    tighter = 0
    for _ in range(200):
        old = rng.integers(-60, 60, (5, 3))
        new = old + rng.integers(-12, 12, (5, 3)) * rng.integers(0, 2, (5, 1))
        radius = rng.uniform(0, 30, 5)
        loose = clustering.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(5):
            way = rng.normal(size=(300, 3))
            points = old[i] + radius[i] * way / np.linalg.norm(way, axis=1, keepdims=True)
            for j in set(range(5)) - {i}:
                nearer = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert nearer.max() <= loose[i]
            others = np.delete(drift, i).max()
            assert loose[i] <= others * (1 + 1e-6) + 1e-6
            tighter += loose[i] < 0.9 * others
    assert tighter > 100


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [0.5, 0.25]), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [0.0, -inf]),
        (8, [0.1, -0.1]), (8, [0.1, -0.1]), (8, [-3.0, 2.0]), (9, [0.1, -0.1]), (10, [1.0, 2.0, 3.0]), (11, [0.0, 0.0]),
    ]
    schema = "vec_id long, embedding array<double>, cluster string, x string, row string"
    frame = spark.createDataFrame([(*r, "theirs", "theirs", "theirs") for r in rows], schema)
    for k in (2, 16):
        found = clustering.cluster_vectors(frame, k=k, dims=2)
        assert result(found) == brute(rows, k, 3, 2)
        assert {(r.x, r.row) for r in found.collect()} == {("theirs", "theirs")}
    assert clustering.cluster_vectors(frame.limit(0), dims=2).collect() == []


def test_huge_components_are_bounded(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0])]
    found = clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, rounds=1, dims=2)
    assert {r.distance for r in found.collect()} == {(1 << 27) ** 2}
