"""k-means in exact integers with Hamerly's bounds.

Every vector keeps one upper bound of the distance to its centroid and one lower bound of the distance to the
second nearest, in a table written a round. When centroids move, the bounds are loosened by their drift; only a
vector whose bounds no longer tell the nearest apart gets its distance anew, and if that isn't enough either, a
full scan of all centroids. Bounds are doubles, rounded outwards; every distance and every sum is an exact
integer, so results don't depend on partitions, batches or the order of rows.

Only sums travel: a row a partition, centroid and component. k centroids go to the driver and into tasks.

A vector takes part if it has exactly `size` components, none of them null or non-finite (nor so large that scale * x
isn't finite). Components become floor(scale * x). Repeated rows are vectors of their own. Starting vectors are those of
smallest hash (null ids last, equal ids by their components); with fewer than k vectors there are as many
centroids as vectors, and an empty table gives none. Components of any size are exact; a distance or an inertia
that doesn't fit a long is null. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .vectors import matrix, usable, whole

#: Integers up to SMALL have squared distances in 64 components, and LIMB bits have products with them, that doubles hold exactly.
SMALL, LIMB = 1 << 22, 20
LARGEST = (1 << 63) - 1


def limbs(v: np.ndarray) -> list[np.ndarray]:
    """Doubles of LIMB bits and a sign, with v = sum of limbs[i] << LIMB * i; v holds whole doubles or Python integers."""
    sign, left, out = np.where(v < 0, -1.0, 1.0), abs(v), []
    while not out or (left != 0).any():
        low = left % (1 << LIMB)
        out.append(sign * low.astype(np.float64))
        left = (left - low) // (1 << LIMB)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact Python integers."""
    total = np.zeros((len(a), len(b)), object)
    for i, x in enumerate(limbs(a)):
        for j, y in enumerate(limbs(b)):
            total += (x @ y.T).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def norms(a: np.ndarray) -> np.ndarray:
    parts, total = limbs(a), np.zeros(len(a), object)
    for i, x in enumerate(parts):
        for j, y in enumerate(parts):
            total += (x * y).sum(axis=1).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


class Centroids:
    """k integer centroids and exact squared distances to them."""

    def __init__(self, rows: list[list[int]]):
        exact = np.array(rows, object).reshape(len(rows), -1)
        self.small = bool((abs(exact) <= SMALL).all())
        self.c = exact.astype(np.float64) if self.small else exact
        self.norm = (self.c**2).sum(axis=1) if self.small else norms(exact)

    def __len__(self) -> int:
        return len(self.c)

    def scan(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to all centroids: doubles of whole value if all is small, else Python integers."""
        if not len(x) or self.small and abs(x).max(initial=0) <= SMALL:
            return (x**2).sum(axis=1)[:, None] - 2 * (x @ self.c.T) + self.norm if len(x) else np.zeros((0, len(self)))
        return norms(x)[:, None] - 2 * products(x, self.c) + (self.norm.astype(np.int64).astype(object) if self.small else self.norm)

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances of rows to one centroid each."""
        if self.small and abs(x).max(initial=0) <= SMALL:
            return ((x - self.c[cluster]) ** 2).sum(axis=1)
        out = np.zeros(len(x), object)
        for j in np.unique(cluster).tolist():
            at = np.flatnonzero(cluster == j)
            one = Centroids([[int(v) for v in self.c[j]]])
            out[at] = [int(v) for v in one.scan(x[at])[:, 0]]
        return out


def above(d: np.ndarray) -> np.ndarray:
    """Doubles not under the roots of d."""
    if d.dtype == object:
        d = np.array([float(min(math.isqrt(int(v)) + 1, 10**300)) if v < 10**600 else math.inf for v in d.ravel()]).reshape(d.shape)
        return d * (1 + 1e-12)
    return np.sqrt(d) * (1 + 1e-12)


def below(d: np.ndarray) -> np.ndarray:
    """Doubles not over the roots of d."""
    if d.dtype == object:
        return np.array([float(min(math.isqrt(int(v)), 10**300)) for v in d.ravel()]).reshape(d.shape) * (1 - 1e-12)
    return np.sqrt(d) * (1 - 1e-12)


class Step:
    """What a round knows: its centroids, how far each has come since the bounds were made, half the way from each to the nearest other."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None = None):
        self.centroids, k = Centroids(now), len(now)
        self.drift = above(self.centroids.own(Centroids(before).c, np.arange(k))) if before else np.zeros(k)
        self.most_of_others = np.array([max(np.delete(self.drift, j), default=0.0) for j in range(k)])
        self.half = np.full(k, np.inf)
        if k > 1:
            near = below(self.centroids.scan(self.centroids.c))
            np.fill_diagonal(near, np.inf)
            self.half = near.min(axis=1) / 2 * (1 - 1e-12)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Clusters and bounds of rows, from their last ones (cluster -1: none), and which rows were scanned."""
        cluster, known = cluster.copy(), cluster >= 0
        at = np.where(known, cluster, 0)
        with np.errstate(invalid="ignore"):
            upper = np.where(known, (upper + self.drift[at]) * (1 + 1e-12), np.inf)
            lower = np.where(known, lower - self.most_of_others[at], 0.0)
        lower = np.maximum(np.nan_to_num(lower - abs(lower) * 1e-12, nan=0.0, posinf=0.0, neginf=0.0), 0.0)
        bound = np.where(known, np.maximum(lower, self.half[at]), -1.0)
        unsure = np.flatnonzero(known & ~(upper < bound))
        if len(unsure):
            upper[unsure] = above(self.centroids.own(x[unsure], cluster[unsure]))
        scanned = np.flatnonzero(~(upper < bound))
        for part in np.array_split(scanned, max(1, len(scanned) * len(self.centroids) >> 20)):
            if len(part):
                d = self.centroids.scan(x[part])
                cluster[part] = best = d.argmin(axis=1)  # of equal ones the first
                i = np.arange(len(part))
                upper[part] = above(d[i, best])
                if len(self.centroids) > 1:
                    d[i, best] = d.max() + 1
                    lower[part] = below(d.min(axis=1))
                else:
                    lower[part] = np.inf
        return cluster, upper, lower, scanned


STATE = "vec_id {id}, x array<double>, cluster int, upper double, lower double"


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return matrix(batch.column("x")).reshape(len(batch), size)


def _rows(batch: pa.RecordBatch, name: str, fill: float, kind) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(kind) if name in batch.schema.names else np.full(len(batch), fill, kind)


def _assigned(step: Step, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = step.assign(_vectors(b, size), _rows(b, "cluster", -1, np.int64), _rows(b, "upper", np.inf, np.float64), _rows(b, "lower", 0, np.float64))
            cluster, upper, lower, _ = found
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "x", "cluster", "upper", "lower"])

    return run


def _measured(step: Step, size: int):
    """The last assignment, with exact distances instead of vectors and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b, size)
            cluster, *_ = step.assign(x, _rows(b, "cluster", -1, np.int64), _rows(b, "upper", np.inf, np.float64), _rows(b, "lower", 0, np.float64))
            d = [v if v <= LARGEST else None for v in map(int, step.centroids.own(x, cluster))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _partial_sums(size: int):
    """(cluster, limb, place, total) of a partition: sums of components at places from 0, the number of vectors at place `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x, cluster = np.hstack([_vectors(b, size), np.ones((len(b), 1))]), _rows(b, "cluster", -1, np.int64)
            for j in np.unique(cluster).tolist():
                for i, part in enumerate(limbs(x[cluster == j])):
                    at = sums.setdefault((j, i), np.zeros(size + 1, np.int64))
                    at += part.sum(axis=0).astype(np.int64)
        for (j, i), total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([j] * n, pa.int32()), pa.array([i] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(total)], ["cluster", "limb", "place", "total"])

    return run


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids as the exact floors of their vectors' means; those without vectors stay."""
    size = len(centroids[0])
    rows = state.select("cluster", "x").mapInArrow(_partial_sums(size), "cluster int, limb int, place int, total long")
    # At most k * limbs * (size + 1) rows.
    totals = [[0] * (size + 1) for _ in centroids]
    for r in rows.groupBy("cluster", "limb", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        totals[r.cluster][r.place] += int(r.total) << LIMB * r.limb
    return [[v // t[size] for v in t[:size]] if t[size] else c for c, t in zip(centroids, totals, strict=True)]


def clusters(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x")).where(usable("x", zero=True) & (F.size("x") == size))
    kept = kept.select("vec_id", whole("x", scale).alias("x")).where(~F.exists("x", lambda c: F.abs(c) == float("inf")))
    first = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    now, before, state = [[int(v) for v in r.x] for r in first], None, kept
    if not now:
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    shape = STATE.format(id=kept.schema["vec_id"].dataType.simpleString())
    for _ in range(rounds):
        after = written(state.mapInArrow(_assigned(Step(now, before), size), shape), "bounds")
        dropped(state)
        state, before, now = after, now, moved(after, now)
    found = written(state.mapInArrow(_measured(Step(now, before), size), f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), "clusters")
    dropped(state)
    # A row a cluster. A distance that is null is beyond a long, and so are its sums.
    totals = {r.cluster: None if r.beyond else int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()}
    fit = lambda v: v if v is not None and v <= LARGEST else None
    everything = fit(None if None in totals.values() else sum(totals.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    about = rows.sparkSession.createDataFrame([(j, fit(t), everything, digest[j]) for j, t in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
