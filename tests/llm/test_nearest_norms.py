"""The nearest search where norms differ."""

import math

import numpy as np
import pytest

from tessera.llm import cross_polytope


@pytest.mark.parametrize("case", ["outlier", "spread"])
def test_recall_with_unequal_norms(spark, case):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x * np.exp(rng.normal(0, 0.7, 1500))[:, None] if case == "spread" else x
    x[7] *= 100 if case == "outlier" else 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got.get(q, set()) & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * 75) >= 0.9


@pytest.mark.parametrize("n", [10, 30])
def test_every_query_gets_all_it_is_due(spark, n):
    x = np.random.default_rng(5).normal(0, 1, (n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "vec_id long, embedding array<double>")
    for part in (4, 16384):
        got = cross_polytope.nearest(df, df, block=part, tasks=2).collect()
        assert len(got) == n * min(20, n - 1) and len({(r.query_id, r.vec_id) for r in got}) == len(got)


@pytest.mark.parametrize("polytopes", [1, 2])
def test_clusters_need_few_probes(polytopes):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (40, 30))
    x = np.repeat(centres, 30, axis=0) + rng.normal(0, 0.1, (1200, 30))
    norm = np.linalg.norm(x, axis=1)
    bands = {b: float(norm[cross_polytope._band(norm) == b].max()) for b in set(cross_polytope._band(norm).tolist())}
    index = cross_polytope.CrossPolytope(30, bands, 1.5 * float(np.median(norm)), 8, polytopes)
    probes = index.fitted(rng.permutation(x), np.arange(1200), 20, 0.95)
    assert probes <= 0.2 * index.width and index.width == (2 * 32) ** polytopes


def test_repeated_ids_and_ties(spark):
    from tessera.llm import bit_sliced

    v = [1.0, 0.5, -0.25]
    rows = [(20, v), (20, v), (20, [9.0, 0.0, 0.0]), (7, v), (7, v), (7, [0.5, 0.5, 0.0]), (9, v), (3, v), (40, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found in (cross_polytope.nearest(df, df.where("vec_id % 20 = 0"), k=4, tasks=2), bit_sliced.exact_top(df, df.where("vec_id % 20 = 0"), k=4)):
        got = {q: [(r.rank, r.vec_id) for r in found.where(f"query_id = {q}").orderBy("rank").collect()] for q in (20, 40)}
        assert got[20] == [(1, 3), (2, 7), (3, 7), (4, 9)]
        assert [r for r, _ in got[40]] == [1, 2, 3, 4] and 40 not in {j for _, j in got[40]}


def brute_scores(rows, q, k):
    """(vec_id, score as a long) of the k best by exact score."""
    x = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(x[q], x[j])), j) for j in x if j != q)[:k]
    return [(j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, j in want]


def test_huge_components_are_exact_and_widen_no_other_block(spark):
    from tessera.llm import bit_sliced

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(60)]
    rows += [(100, [1e20] + [0.0] * 7), (101, [-3e9, 1.0] + [0.0] * 6), (102, [3e12] * 8), (103, [1e160] * 8), (104, [-1e160] * 8), (120, [0.0] * 7 + [1e300]), (140, [-1e9] + [0.5] * 7)]
    df = spark.createDataFrame([*rows, (160, [1e308] * 8)], "vec_id long, embedding array<double>")
    got = {}
    for r in bit_sliced.exact_top(df, df.where("vec_id % 20 = 0"), k=66).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100, 120, 140}
    for q, found in got.items():
        assert [(j, s) for _, j, s in sorted(found)] == brute_scores(rows, q, 66)


def test_large_scores_that_fit_a_long(spark):
    from tessera.llm import bit_sliced

    rows = [(20, [1.0, 0.0]), (1, [5e6, 0.0]), (2, [1e7, 0.0]), (3, [2e14, 7.0]), (4, [-2e14, 7.0])]
    got = bit_sliced.exact_top(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), df.where("vec_id = 20"), k=4).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(3, 64 * 64 * 200_000_000_000_000), (2, 40_960_000_000), (1, 20_480_000_000), (4, -64 * 64 * 200_000_000_000_000)]


def test_tiny_vectors_take_part(spark):
    rows = [(i, [1e-170 * (i + 1), 1e-171, 0.0]) for i in range(30)] + [(40, [1.0, 2.0, 3.0]), (60, [3e200, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cross_polytope.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    assert len(got) == 4 * 5 and all(r.rank <= 5 for r in got)


@pytest.mark.parametrize(("kind", "n", "most"), [("clustered", 4000, 0.15), ("clustered", 12000, 0.15), ("spread", 4000, 0.9)])
def test_buckets_decide_what_is_multiplied(kind, n, most):
    """Pairs scored, as a share of all, and recall against brute force, at two sizes."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (n, 64))
    if kind == "clustered":
        x = np.repeat(rng.normal(0, 1, (n // 40, 64)), 40, axis=0) + rng.normal(0, 0.15, (n, 64))
        x = rng.permutation(x)
    norm = cross_polytope.norms(x)
    bands = {b: float(norm[cross_polytope._band(norm) == b].max()) for b in set(cross_polytope._band(norm).tolist())}
    index = cross_polytope.CrossPolytope(64, bands, 1.5 * float(np.median(norm)))
    probes = index.fitted(x, np.arange(n), 20, 0.95)
    place, every = index.buckets(x)
    lists = cross_polytope.Lists(place, every, index.width)
    queries = np.arange(0, n, n // 50)
    probed = np.stack([np.argpartition(-a, probes - 1, axis=1)[:, :probes] for a in index.nearness(x[queries])], axis=1)
    scored = hits = 0
    for q, buckets in zip(queries, probed):
        at = lists.candidates(buckets)
        assert not lists.seen.any() and len(set(at.tolist())) == len(at)
        assert set(at.tolist()) == {i for i in range(n) if every[i] or any(place[t][i] in buckets[t] for t in range(8))} if q < 400 else True
        at = at[at != q]
        scored += len(at)
        near, _ = cross_polytope.top_of(x[q], x[at], at, 20)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(near.tolist()) & set(np.argsort(-s)[:20].tolist()))
    print(kind, n, probes, scored / len(queries) / n, hits / 20 / len(queries))
    assert hits / 20 / len(queries) >= 0.9 and scored / len(queries) / n <= most
