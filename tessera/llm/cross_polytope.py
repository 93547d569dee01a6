"""Approximate nearest neighbours by cross-polytope hashing with multiple probes and exact reranking.

For the largest inner product, rows are taken in bands of norms within a factor of 1.25, and made unit ones by a
further coordinate (the square root of what their squared norm lacks to the band's largest; 0 for queries), padded to a
power of two and turned by a pseudo-rotation: three rounds of random signs and a fast Hadamard transform. A vector's
bucket in a table is the signed axis nearest to it, of one such polytope or of `polytopes` together. A query probes the buckets
nearest to it in each of the `tables`; rows in any of them are its candidates, and only with these is it multiplied:
exactly, by the original vectors in double precision.

How many buckets are probed is fitted: among `SAMPLE` rows at most, 256 of them as queries, the nearest of the same
share as k has of all rows must be met with a frequency of `target`. Clustered vectors need a few probes; vectors
without structure need buckets that hold a good part of all rows, whatever the index.

Each row is hashed once and each query's probes are found once. They meet in tiles: a block of rows, which lists its rows by
table and bucket, and a group of queries, each of which gathers the lists of its probes and multiplies the rows in them, each
once. A vector is shuffled once for each tile it is in, and a tile's memory is bounded.

All bands are probed. Rows of bands above 1.5 times the median norm are near to any query in inner product
whatever their direction, so they are every query's candidates. A query whose probes met fewer than k rows
meets all of them.

Null, empty, zero and non-finite vectors take no part, nor do null ids and vectors of another size than the commonest.
A table without usable vectors gives no rows. Ties go to the smaller id. Rows that share an id are candidates of
their own, and none of them is a candidate of a query with that id; of queries that share an id the one with the least
vector, component by component, asks. Other columns don't matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .vectors import best, matrix, of_one_size, usable

#: Rows that the number of probes is fitted on, and queries among them.
SAMPLE, ASKED = 20_000, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in n log n steps."""
    rows, n = x.shape
    h = 1
    while h < n:
        y = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """bands: the largest norm of each band of rows; rows of those above `whole` are candidates of every query."""

    def __init__(self, dimensions: int, bands: dict[int, float], whole: float, tables: int = 8, polytopes: int = 1, seed: int = 1):
        self.d, self.bands, self.whole = dimensions, bands, whole
        self.tables, self.polytopes = tables, polytopes
        self.n = 1 << dimensions.bit_length()  # room for the further coordinate
        self.width = (2 * self.n) ** polytopes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, polytopes, 3, self.n))

    def _axes(self, y: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            y = hadamard(y * s)
        return np.concatenate([y, -y], 1)

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tables x rows: the bucket of each row, whether a row is every query's candidate)."""
        norm = norms(x)
        largest = np.maximum(norm, [self.bands.get(b, 0.0) for b in _band(norm).tolist()])  # at an edge, logarithms may round apart
        y = np.zeros((len(x), self.n))
        y[:, : self.d] = x / largest[:, None]
        y[:, self.d] = np.sqrt(np.maximum(0, 1 - (y**2).sum(1)))
        out = np.zeros((self.tables, len(x)), np.int64)
        for t, polytopes in enumerate(self.signs):
            for signs in polytopes:
                out[t] = out[t] * 2 * self.n + self._axes(y, signs).argmax(1)
        return out, largest > self.whole

    def nearness(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each table, queries x buckets: how near each bucket's axes are."""
        y = np.zeros((len(x), self.n))
        y[:, : self.d] = x / norms(x)[:, None]
        for polytopes in self.signs:
            total = self._axes(y, polytopes[0])
            for signs in polytopes[1:]:
                total = (total[:, :, None] + self._axes(y, signs)[:, None, :]).reshape(len(x), -1)
            yield total

    def fitted(self, rows: np.ndarray, ids: np.ndarray, k: int, target: float) -> int:
        """The probes that meet a share of `target` of the k nearest of some of these rows."""
        queries = rows[:ASKED]
        scores = queries @ rows.T
        scores[ids[:ASKED, None] == ids[None, :]] = -np.inf
        near = np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k]
        place, every = self.buckets(rows)
        least = np.full(near.shape, self.width)
        for t, axes in enumerate(self.nearness(queries)):
            value = np.take_along_axis(axes, place[t][near], 1)
            for j in range(near.shape[1]):
                least[:, j] = np.minimum(least[:, j], (axes > value[:, j : j + 1]).sum(1))
        least[every[near] | (np.take_along_axis(scores, near, 1) == -np.inf)] = 0
        return int(np.quantile(least, target, method="higher")) + 1


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows; divided by their largest component first, so that squares neither vanish nor overflow."""
    most = abs(x).max(1, keepdims=True, initial=0)
    return most[:, 0] * np.linalg.norm(x / np.where(most > 0, most, 1), axis=1)


def _band(norm: np.ndarray) -> np.ndarray:
    return np.floor(np.log(norm) / np.log(1.25)).astype(np.int64)


class Lists:
    """A block's rows by table and bucket."""

    def __init__(self, place: np.ndarray, every: np.ndarray, width: int):
        self.order = [np.argsort(p, kind="stable") for p in place]
        self.starts = [np.searchsorted(p[o], np.arange(width + 1)).tolist() for p, o in zip(place, self.order, strict=True)]
        self.every, self.seen = np.flatnonzero(every), np.zeros(len(every), bool)

    def candidates(self, probed: np.ndarray) -> np.ndarray:
        """Rows in any of the probed buckets (tables x probes), each once."""
        for order, starts, buckets in zip(self.order, self.starts, probed.tolist(), strict=True):
            self.seen[np.concatenate([order[starts[b] : starts[b + 1]] for b in buckets])] = True
        self.seen[self.every] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


def top_of(v: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k rows nearest to one query.

    A product of matrices may round equal pairs apart, so all within a hair of the k-th are scored again,
    each by the same sum, and ties are settled by id.
    """
    scores = rows @ v
    if len(scores) > 2 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        hair = 1e-12 * norms(v[None, :])[0] * norms(rows).max()
        near = np.flatnonzero(~(scores < limit - hair))
        rows, ids = rows[near], ids[near]
    _, ids, scores = best(np.zeros(len(ids), np.int64), ids, np.einsum("ij,ij->i", np.broadcast_to(v, rows.shape), rows), k)
    return ids, scores


def _placed(index: CrossPolytope):
    """Rows with their bucket in each table, and whether every query takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, every = index.buckets(matrix(b.column("v"))) if len(b) else (np.zeros((index.tables, 0), np.int64), np.zeros(0, bool))
            hashed = pa.array([r.tobytes() for r in place.T.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), hashed, pa.array(every)], ["id", "v", "hashed", "every"])

    return run


def _probing(index: CrossPolytope, probes: int):
    """Queries with the buckets they probe in each table."""
    m = min(probes, index.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1000):
                b = whole.slice(a, 1000)
                found = np.stack([np.argpartition(-axes, m - 1, axis=1)[:, :m] for axes in index.nearness(matrix(b.column("v")))], axis=1)
                hashed = pa.array([r.tobytes() for r in found.astype(np.int32)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), hashed, pa.array([False] * len(b))], ["id", "v", "hashed", "every"])

    return run


def _tiles(index: CrossPolytope, k: int, listed: bool):
    """Scores a partition sorted by tile, the block's rows first. Not listed: all rows are candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "grp", "is_query")])
            ids, x, hashed = batch.column("id").to_numpy(zero_copy_only=False), matrix(batch.column("v")), batch.column("hashed")
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if (here := tuple(keys[:2, a].tolist())) != key:
                    key, parts, block = here, [], None
                if not keys[2, a]:
                    parts.append((ids[a:b], x[a:b], hashed[a:b].to_pylist(), batch.column("every")[a:b].to_numpy(zero_copy_only=False)))
                    continue
                if not parts and block is None:
                    continue
                if block is None:
                    own, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    place = np.frombuffer(b"".join(h for p in parts for h in p[2]), np.int32).reshape(len(own), -1).T
                    block, parts = (own, rows, Lists(place, np.concatenate([p[3] for p in parts]), index.width) if listed else None), []
                own, rows, lists = block
                found = []
                for i in range(a, b):
                    at = lists.candidates(np.frombuffer(hashed[i].as_py(), np.int32).reshape(index.tables, -1)) if lists else np.arange(len(own))
                    at = at[own[at] != ids[i]]
                    near, scores = top_of(x[i], rows[at], own[at], k)
                    found.append((np.full(len(near), ids[i]), near, scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (query_id, vec_id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(rows: DataFrame, queries: DataFrame, blocks: int, groups: int, tile, k: int) -> DataFrame:
    """Every query against every block of rows."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    rows = rows.select(part(blocks).alias("block"), F.lit(0).alias("is_query"), "id", "v", "hashed", "every").withColumn("grp", spread(groups))
    queries = queries.select(part(groups).alias("grp"), F.lit(1).alias("is_query"), "id", "v", "hashed", "every").withColumn("block", spread(blocks))
    met = rows.unionByName(queries).repartition("block", "grp").sortWithinPartitions("block", "grp", "is_query")
    return ranked(met.mapInArrow(tile, "query_id long, vec_id long, score double"), k)


def nearest(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 8, target: float = 0.95, block: int = 65_536, group: int = 65_536, tasks: int = 12, seed: int = 1, polytopes: int = 1) -> DataFrame:
    """Each query's k rows found with the largest inner product, those of its own id left out: query_id, rank, vec_id, score.

    target: the share of the nearest that the fitted number of probes must meet. tasks: the least number of blocks. polytopes: how many make a bucket; two give
    buckets in the square of their number, for tables of very many clustered vectors.
    """
    spark = rows.sparkSession
    taken = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(usable("v", zero=False) & F.col("id").isNotNull())
    rows, d = of_one_size(taken(rows), "v")
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = taken(queries).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.col("most"), F.lit(2)))
    lengths = rows.select("v", most.alias("most")).select((F.col("most") * F.sqrt(squares)).alias("norm"))
    n, middle = lengths.agg(F.count("*"), F.percentile_approx("norm", 0.5)).first()
    near = F.floor(F.log("norm") / float(np.log(1.25)))
    bands = {int(b): float(m) for b, m in lengths.groupBy(near.alias("band")).agg(F.max("norm")).collect()}  # a few bands for each power of ten
    index = CrossPolytope(d, bands, 1.5 * middle, tables, polytopes, seed)
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    probes = index.fitted(np.array([r["v"] for r in some], np.float64), np.array([r["id"] for r in some]), max(1, round(k * len(some) / n)), target)
    blocks, groups = max(-(-n // block), tasks), -(-max(1, queries.count()) // group)
    shape = f"id long, v {rows.schema['v'].dataType.simpleString()}, hashed binary, every boolean"
    rows, asked = rows.mapInArrow(_placed(index), shape), queries.mapInArrow(_probing(index, probes), shape.replace(rows.schema["v"].dataType.simpleString(), queries.schema["v"].dataType.simpleString()))
    found = written(_scored(rows, asked, blocks, groups, _tiles(index, k, True), k), "found")
    # Queries whose probes met fewer than k rows meet every row.
    few = written(queries.join(found.groupBy("query_id").count().where(F.col("count") >= k), F.col("id") == F.col("query_id"), "left_anti").select("id", "v"), "short")
    short = few.count()
    if not short:
        dropped(few)
        return found
    few = few.withColumns({"hashed": F.lit(None).cast("binary"), "every": F.lit(False)})
    more = _scored(rows, few, blocks, -(-short // group), _tiles(index, k, False), k)
    return found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
