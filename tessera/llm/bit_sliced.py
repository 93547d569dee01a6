"""Exact top-k inner products over a bit-sliced index.

Components are integers. A block of rows keeps, for each component, a bitmap of its rows for each bit of
component - smallest, as many as the block's own values of that component take. A query's score is a sum of shifted
slices: for a positive weight the slices of the component, for a negative one their complements, so that only sums of
non-negative numbers are needed, plus a constant. Slices are added by bitmap full adders, a word at a time for 64 rows.
The top k are found from the most significant slice of the sums downward: rows with the bit set, if they are at most
k, are in; if more, the others are out. What still ties at the end is settled exactly by the smaller id,
as the rows of a block are in order of their ids.

Rows go into blocks with others of the same magnitude, so that a large component widens no other block. All rows are
indexed and every query meets every block, in tiles: an index block, some MB, and a group of queries that passes by it.

Components of any size are exact, as slices are as many as they need: they travel as doubles, which hold floor(scale * x) wholly.
A score beyond a long is given as the nearest long, but ranked by what it is. Null, empty and non-finite vectors take no part (zero ones do),
nor do vectors with a scale * x that isn't finite, null ids and vectors of another size than the commonest. Rows that share an id are candidates of their own, and none of them is a
candidate of a query with that id; of queries that share an id the one with the least vector, component by component,
asks. A table without usable vectors gives no rows. Other columns don't matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, of_one_size, usable, whole

LEAST, LARGEST = -(1 << 63), (1 << 63) - 1


class BitSlices:
    """Of rows of integers, in order: slices[component][bit], a bitmap of 64-row words each; smallest[component]."""

    def __init__(self, slices: list[np.ndarray], rows: int, smallest: list[int]):
        self.slices, self.rows, self.smallest = slices, rows, smallest
        self.words = -(-rows // 64)

    @classmethod
    def of(cls, x: np.ndarray) -> BitSlices:
        """Of doubles of whole value."""
        n, d = x.shape
        smallest = [int(v) for v in x.min(0)] if n else [0] * d
        plain = not n or abs(x).max() < 1 << 62
        x = x.astype(np.int64) if plain else np.array([[int(v) for v in r] for r in x], object)
        out = []
        for c in range(d):
            value = np.zeros(-(-n // 64) * 64, np.uint64 if plain else object)
            value[:n] = x[:, c] - smallest[c]
            bits = int(value.max()).bit_length() if n else 0
            one = np.uint64 if plain else int
            planes = [np.packbits((value >> one(b) & one(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(bits)]
            out.append(np.stack(planes) if planes else np.zeros((0, len(value) // 64), np.uint64))
        return cls(out, n, smallest)

    def to_bytes(self) -> tuple[bytes, list[int]]:
        return b"".join(s.tobytes() for s in self.slices), [len(s) for s in self.slices]

    @classmethod
    def from_bytes(cls, raw: bytes, bits: list[int], rows: int, smallest: list[int]) -> BitSlices:
        words = np.frombuffer(raw, np.uint64).reshape(sum(bits), -(-rows // 64))
        return cls(np.split(words, np.cumsum(bits)[:-1]), rows, smallest)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores less a constant, and the constant."""
        columns: list[list[np.ndarray]] = []
        constant = 0
        for weight, slices, smallest in zip(map(int, query.tolist()), self.slices, self.smallest, strict=True):
            if not weight:
                continue
            constant += weight * (smallest if weight > 0 else (1 << len(slices)) - 1 + smallest)
            used = [s if weight > 0 else ~s for s in slices]
            size, shift = abs(weight), 0
            while size:
                if size & 1:
                    while len(columns) < shift + len(used):
                        columns.append([])
                    for b, s in enumerate(used):
                        columns[shift + b].append(s)
                size >>= 1
                shift += 1
        i = 0
        while i < len(columns):
            column = columns[i]
            if len(column) > 1 and i + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                carry = a & b
                carry |= x & c
                x ^= c
                column.insert(0, x)
                columns[i + 1].append(carry)
            if len(column) == 2:
                a, b = column
                columns[i] = [a ^ b]
                columns[i + 1].append(a & b)
            i += 1
        empty = np.zeros(self.words, np.uint64)
        return [c[0] if c else empty for c in columns], constant

    def top(self, query: np.ndarray, k: int, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows, ties to the lower place; the places `without` are left out."""
        sums, constant = self.sums(query)
        tied = np.full(self.words, ~np.uint64(0))
        if self.rows % 64:
            tied[-1] = (np.uint64(1) << np.uint64(self.rows % 64)) - np.uint64(1)
        for p in without.tolist():
            tied[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        sure = np.zeros_like(tied)
        have = 0
        for s in reversed(sums):
            one = tied & s
            n = int(np.bitwise_count(one).sum())
            if have + n > k:
                tied = one
            else:
                sure |= one
                have += n
                tied &= ~s
                if have == k:
                    break
        places = _places(sure)
        if have < k:
            places = np.concatenate([places, _places(tied)[: k - have]])
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        set_ = [s[word] >> bit & np.uint64(1) for s in sums]
        if len(sums) < 62 and abs(constant) < 1 << 62:
            scores = np.full(len(places), constant, np.int64)
            for i, s in enumerate(set_):
                scores += s.astype(np.int64) << i
        else:
            scores = np.full(len(places), constant, object)
            for i, s in enumerate(set_):
                scores += s.astype(object) * (1 << i)
        return places, scores


def beyond(score: int) -> bytes | None:
    """For a score that doesn't fit a long, bytes that sort as such scores do; positive ones begin with a byte over 127."""
    if LEAST <= score <= LARGEST:
        return None
    raw = abs(score).to_bytes((score.bit_length() + 7) // 8)
    raw = b"\xff" + len(raw).to_bytes(4) + raw
    return raw if score > 0 else bytes(255 - b for b in raw)


def _places(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


_INDEX = ["block", "ids", "smallest", "bits", "slices"]


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows, sorted by block, as an index for each block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    block = None

    def made() -> pa.RecordBatch:
        ids, x = (np.concatenate(p) for p in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        index = BitSlices.of(x[order])
        raw, bits = index.to_bytes()
        cols = [pa.array([block], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([list(map(float, index.smallest))], pa.list_(pa.float64())), pa.array([bits], pa.list_(pa.int32())), pa.array([raw], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, _INDEX)

    for batch in batches:
        blocks, ids, x = batch.column("block").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False), matrix(batch.column("x"))
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and blocks[a] != block:
                yield made()
                held = []
            block = int(blocks[a])
            held.append((ids[a:b], x[a:b]))
    if held:
        yield made()


def _tiles(k: int):
    """Scores a partition sorted by tile, the index row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, ids = None, None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            blocks, groups, queries = (batch.column(c).to_pylist() for c in ("block", "grp", "is_query"))
            for i, here in enumerate(zip(blocks, groups, strict=True)):
                if not queries[i]:
                    raw_ids, smallest, bits, raw = (batch.column(c)[i].as_py() for c in _INDEX[1:])
                    key, ids = here, np.frombuffer(raw_ids, np.int64)
                    index = BitSlices.from_bytes(raw, bits, len(ids), list(map(int, smallest)))
                elif here == key:
                    q = batch.column("id")[i].as_py()
                    places, scores = index.top(batch.column("x")[i].values.to_numpy(zero_copy_only=False), k, np.arange(*np.searchsorted(ids, [q, q + 1])))
                    for c, v in zip(out, (np.full(len(places), q), ids[places], scores), strict=True):
                        c.append(v)
            if out[0]:
                query, vec, score = map(np.concatenate, out)
                more = [beyond(s) if score.dtype == object else None for s in score.tolist()]
                score = score if score.dtype != object else [min(max(s, LEAST), LARGEST) for s in score.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score, pa.int64()), pa.array(more, pa.binary())], ["query_id", "vec_id", "score", "beyond"])

    return run


def exact_top(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64, block: int = 131_072, group: int = 65_536, tasks: int = 24) -> DataFrame:
    """Each query's k rows of the largest integer inner product, those of its own id left out: query_id, rank, vec_id, score.

    tasks: the least number of tiles; queries of a small table are dealt into more groups for it.
    """
    spark = rows.sparkSession
    taken = lambda df: df.where(usable(vector, zero=True) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    rows, d = of_one_size(taken(rows), "v")
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, queries = (df.select("id", whole("v", scale).alias("x")).where(~F.exists("x", lambda c: F.abs(c) == float("inf"))) for df in (rows, taken(queries).where(F.size("v") == d)))
    queries = queries.groupBy("id").agg(F.min("x").alias("x"))
    # Magnitudes go by the bits of the largest component, those up to 2 bits more than the commonest together; 1024 classes at most.
    largest = F.greatest(F.array_max("x"), -F.array_min("x"))
    size = F.when(largest < 1, 1).otherwise(F.floor(F.log2(F.greatest(largest, F.lit(1.0)))) + 1).cast("int")
    sizes = {r["bits"]: r["count"] for r in rows.groupBy(size.alias("bits")).count().collect()}
    usual = max(sizes, key=lambda b: (sizes[b], -b))
    of = {b: (0 if b <= usual + 2 else b) for b in sizes}
    counts: dict[int, int] = {}
    for b, n in sizes.items():
        counts[of[b]] = counts.get(of[b], 0) + n
    first, blocks = {}, 0
    for kind, n in sorted(counts.items()):
        first[kind] = (blocks, -(-n // max(1024, block * 24 // max(24, kind))))  # wide slices, fewer rows
        blocks += first[kind][1]
    place = F.create_map(*(x for b in sizes for x in (F.lit(b), F.struct(F.lit(first[of[b]][0]).alias("at"), F.lit(first[of[b]][1]).alias("n")))))
    rows = rows.withColumn("p", F.element_at(place, size))
    rows = rows.select((F.col("p.at") + F.pmod(F.xxhash64("id", "x"), F.col("p.n"))).cast("int").alias("block"), "id", "x")
    index = written(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_index_rows, "block int, ids binary, smallest array<double>, bits array<int>, slices binary"), "slices")
    groups = max(-(-queries.count() // group), -(-tasks // blocks))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = index.withColumns({"is_query": F.lit(False), "id": F.lit(None).cast("long"), "x": F.lit(None).cast("array<double>")}).withColumn("grp", spread(groups))
    asked = queries.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), F.lit(True).alias("is_query"), "id", "x").withColumn("block", spread(blocks))
    met = index.unionByName(asked, allowMissingColumns=True).repartition("block", "grp").sortWithinPartitions("block", "grp", "is_query")
    found = met.mapInArrow(_tiles(k), "query_id long, vec_id long, score long, beyond binary")
    side = F.when(F.col("beyond").isNull(), 0).otherwise(F.signum("score"))
    order = Window.partitionBy("query_id").orderBy(side.desc(), F.desc("beyond"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
