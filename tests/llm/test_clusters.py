"""Clustering under Hamerly's bounds against plain rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import hamerly

SCHEMA = "vec_id long, embedding array<double>, cluster string, Distance int"


def brute(rows, k, rounds, size, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    fit = lambda v: v if v < 1 << 63 else None
    of = [near(v) for _, v in kept]
    d = [far(v, centroids[c]) for (_, v), c in zip(kept, of, strict=True)]
    per = {j: sum(x for x, c in zip(d, of, strict=True) if c == j) for j in set(of)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, fit(x), fit(per[c]), fit(sum(d)), sha[c]) for (i, _), c, x in zip(kept, of, d, strict=True)]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def made(seed, n, size, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 2, (7, size))
    x = middles[rng.integers(0, 7, n)] + rng.normal(0, spread, (n, size))
    rows = [(int(i), [float(v) for v in r], "c", 1) for i, r in enumerate(x)]
    odd = [(n, None), (n + 1, []), (n + 2, [1.0] * (size - 1)), (n + 3, [float("nan")] + [0.0] * (size - 1)), (n + 4, [None] + [0.0] * (size - 1)), (n + 5, [float("-inf")] * size), (None, [0.25] * size), (None, None)]
    return rows + [(i, v, None, None) for i, v in odd] + rows[:5]


@pytest.mark.parametrize(("seed", "n", "size", "k", "rounds"), [(1, 300, 64, 16, 3), (2, 150, 3, 16, 6), (3, 60, 2, 5, 0), (4, 5, 8, 16, 2)])
def test_clusters_are_those_of_plain_rounds(spark, seed, n, size, k, rounds):
    rows = made(seed, n, size)
    got = hamerly.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, size=size).collect()
    assert in_order(got) == in_order(brute(rows, k, rounds, size))


def test_ties_and_copies(spark):
    """Many equal distances, copies of one vector as starting centroids (the later ones stay empty)."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(2)], "", 0) for i in range(200)] + [(7, [0.0, 0.0], "", 0)] * 40
    got = hamerly.clusters(spark.createDataFrame(rows, SCHEMA).repartition(4), k=9, rounds=3, size=2, scale=1).collect()
    assert in_order(got) == in_order(brute(rows, 9, 3, 2, 1))


def test_components_of_any_size_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.0, 1e6, 3e8, 1e15, -4e38]) * rng.random() for _ in range(4)], "", 0) for i in range(120)]
    got = hamerly.clusters(spark.createDataFrame(rows, SCHEMA).repartition(2), k=6, rounds=3, size=4).collect()
    want = brute(rows, 6, 3, 4)
    assert in_order(got) == in_order(want) and any(r[2] is None for r in want)
    edge = [(i, [float(1 << 16) * i, -float(1 << 16)], "", 0) for i in range(12)]
    assert in_order(hamerly.clusters(spark.createDataFrame(edge, SCHEMA), k=3, rounds=4, size=2).collect()) == in_order(brute(edge, 3, 4, 2))


def test_empty_table(spark):
    got = hamerly.clusters(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_bounds_save_scans_and_stay_right():
    rng = np.random.default_rng(0)
    middles = rng.normal(0, 300, (8, 16)).round()
    x = (middles[rng.integers(0, 8, 4000)] + rng.normal(0, 40, (4000, 16))).round()
    before, now = None, x[:8].astype(int).tolist()
    cluster, upper, lower = np.full(4000, -1), np.full(4000, np.inf), np.zeros(4000)
    scans = []
    for _ in range(6):
        step = hamerly.Step(now, before)
        cluster, upper, lower, scanned = step.assign(x, cluster, upper, lower)
        d = ((x[:, None] - np.array(now, float)[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        d = np.sqrt(d)
        assert (upper >= d[np.arange(4000), cluster]).all()
        d[np.arange(4000), cluster] = np.inf
        assert (lower <= d.min(axis=1)).all()
        scans.append(len(scanned))
        before, now = now, [np.floor(x[cluster == j].mean(axis=0)).astype(int).tolist() if (cluster == j).any() else c for j, c in enumerate(now)]
    assert scans[0] == 4000 and scans[-1] < 1000
