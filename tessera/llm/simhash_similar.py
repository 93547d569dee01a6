"""SimHash near-dedup at a Jaccard similarity: fingerprints of shingle samples propose pairs, the shingle sets decide.

Whole texts of similarity 0.8 have fingerprints about ten of 64 bits apart, too far for a grid whose cells are
small. So a text gets `samples` fingerprints, each the SimHash of `rows` of its shingles, drawn with seeds: each is the one
whose hash under a seed is the smallest, which like texts choose alike. Two texts of similarity j draw the same ones with
probability j^rows and then have the same fingerprint, so at 0.8 all but 3 of 100,000 pairs share one of 20, above it
more. A fingerprint's embedding of segment bit counts is its cell; nothing is linked by that alone: the exact
similarity of the two sets must be `similarity` or more. Texts with one set of shingle hashes are one node.

First of all the whole texts' own fingerprints are joined by simhash_dedup's grid, under its Manhattan bound and within its Hamming
distance; its links, and texts of one fingerprint, are pairs to be decided like the samples'. The samples add those further apart.

A cell of up to `small` nodes proposes all its pairs whose sizes allow the similarity. A larger one first proposes
each node with one other, so a dense group costs as many pairs as it has nodes. Where that leaves its nodes
unconnected, those not connected yet are compared in tiles of `tile` shingles a side. The components are those of all pairs.

Words are those of simhash_dedup; null and wordless texts are one node, texts of fewer words than a shingle are one
shingle. Very long texts are one set each. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, text_or_empty, written
from .components import components
from .shingles import majority, of_hashes, shingle_hashes

#: Up to so many keys are broadcast, having been counted: 8 MB.
FEW = 1_000_000


def shingle_set(raw: bytes, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(raw, words, seed), np.uint64))


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 1)


class Samples:
    """Fingerprints of seeded samples of a set of hashes."""

    def __init__(self, samples: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.flip, self.by = (rng.integers(0, 1 << 64, (samples * rows, 1), np.uint64) for _ in range(2))
        self.by |= np.uint64(1)

    def prints(self, hashes: np.ndarray) -> np.ndarray:
        """One for each sample; none of an empty set."""
        if not len(hashes):
            return np.zeros(0, np.uint64)
        # A seeded hash can be undone, so the smallest one says which shingle it is of.
        least = np.min([((hashes[i : i + 2048] ^ self.flip) * self.by).min(1) for i in range(0, len(hashes), 2048)], 0)
        return majority(least.reshape(self.samples, -1))


def _signed(words: int, seed: int, samples: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Samples(samples, rows, seed)
        for batch in batches:
            names, sizes, keys, prints = [], [], [], []
            for text in batch.column("t"):
                hashes = shingle_hashes(text.as_buffer().to_pybytes(), words, seed)
                prints.append(of_hashes(hashes))
                found = np.unique(np.array(hashes, np.uint64))
                names.append(_name(found))
                sizes.append(len(found))
                keys.append(sample.prints(found).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            s, f = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, prints))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), s, f, pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "tag", "s", "f", "n", "keys"])

    return run


def _sets(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                found = [shingle_set(text.as_buffer().to_pybytes(), words, seed) for text in batch.column("t").slice(i, 500)]
                names = np.array([_name(x) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["s", "hashes"])

    return run


def _proposed(top: int, of: int, small: int):
    """Of a partition sorted by band, key and n: pairs (a, b, null), and the members (a, null, bucket) of large buckets."""

    def settle(rows: list[np.ndarray]) -> pa.RecordBatch:
        band, key, n, s = rows
        edges = np.concatenate([[0], np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1, [len(s)]])
        sizes = np.diff(edges)
        run, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
        a, b = [], []
        for step in range(1, small):
            i = np.flatnonzero((run[step:] == run[:-step]) & (size[step:] <= small))
            if not len(i):
                break
            i = i[n[i] * of >= n[i + step] * top]
            a.append(s[i])
            b.append(s[i + step])
        members, buckets = [], []
        for at in np.flatnonzero(sizes > small).tolist():
            x, y = edges[at], edges[at + 1]
            while x < y:  # the shortest and all that may be similar to it
                z = x + int(np.searchsorted(n[x:y] * top, n[x] * of, "right"))
                a.append(np.full(z - x - 1, s[x]))
                b.append(s[x + 1 : z])
                x = z
            members.append(s[edges[at] : y])
            buckets.append(np.full(y - edges[at], xxhash.xxh64_intdigest(np.array([band[edges[at]], key[edges[at]]]).tobytes()), np.uint64).view(np.int64))
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        a, b, members, buckets = map(join, (a, b, members, buckets))
        ends = [pa.array(np.concatenate([np.minimum(a, b), members])), pa.array(np.concatenate([np.maximum(a, b), members])), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(buckets)])]
        return pa.RecordBatch.from_arrays(ends, ["a", "b", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "key", "n", "s")]
            if not len(rows[0]):
                continue
            ends = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            last = int(ends[-1]) + 1 if len(ends) else 0  # where the last bucket, which may go on, begins
            if held and (held[-1][0][-1] != rows[0][0] or held[-1][1][-1] != rows[1][0]):
                yield settle([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            if last:
                yield settle([np.concatenate(c) for c in zip(*held, [c[:last] for c in rows], strict=True)])
                held = []
            held.append([c[last:] for c in rows])
        if held:
            yield settle([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _across(top: int, of: int):
    """Similar pairs of a tile whose nodes aren't connected yet: of its two sides, or within the one side it has."""

    def run(rows: pa.Table) -> pa.Table:
        s, c, side = (rows.column(x).to_numpy() for x in ("s", "c", "side"))
        sets = rows.column("hashes").combine_chunks()
        flat, sizes = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sets.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        c, a, b = c.copy(), [], []
        both = bool((side != side[0]).any())
        for i in np.flatnonzero(side == side[0]).tolist():
            if (c == c[i]).all():
                break
            own = flat[starts[i] : starts[i] + sizes[i]]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[place] == flat).astype(np.int64), starts)
            near = (common * of >= (sizes + sizes[i] - common) * top) & (c != c[i])
            if both:
                near &= side != side[0]
            for j in np.flatnonzero(near).tolist():
                if c[j] != c[i]:
                    a.append(s[i])
                    b.append(s[j])
                    c[c == c[j]] = c[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _tiles(members: DataFrame, sets: DataFrame, apart: DataFrame, tile: int) -> DataFrame:
    """(bucket, low, high, side, s, c, hashes): members of unconnected buckets, dealt into parts of about `tile` shingles; each pair of parts is a tile."""
    rows = members.join(apart, "bucket")
    parts = F.greatest(F.lit(1), F.ceil(F.col("weight") / tile)).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("s"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    rows = rows.select("bucket", "s", "c", "part", other.alias("other")).withColumn("side", (F.col("part") > F.col("other")).cast("int"))
    rows = rows.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "side", "s", "c")
    return rows.join(sets, "s")


def _near(nodes: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): pairs of nodes whose whole fingerprints are linked or the same, one node for each fingerprint and link."""
    first = written(nodes.groupBy("f").agg(F.min("s").alias("first")), "firsts")
    at = lambda end: first.select(F.col("f").alias(f"f{end}"), F.col("first").alias(end))
    linked = links(first).join(at("a"), "fa").join(at("b"), "fb").select("a", "b")
    same = nodes.select("f", "s").join(first, "f").where("s <> first").select(F.col("first").alias("a"), F.col("s").alias("b"))
    found = written(linked.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near")
    dropped(first)
    return found


def grouped(rows: DataFrame, docs: DataFrame, text: str, words: int, similarity: tuple[int, int], seed: int, small: int, tile: int, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) over all links between sets at `similarity` or more among the cells."""
    top, of = similarity
    nodes = written(rows.groupBy("s").agg(F.min("tag").alias("tag"), F.min("f").alias("f"), F.first("n").alias("n"), F.first("keys").alias("keys")), "sets")
    cells = nodes.select("s", "n", F.posexplode("keys").alias("band", "key")).select("band", "key", "n", "s")
    found = cells.repartition("band", "key").sortWithinPartitions("band", "key", "n", "s").mapInArrow(_proposed(top, of, small), "a long, b long, bucket long")
    found = written(found, "proposed")
    near = _near(nodes, links)
    pairs = written(found.where("bucket is null").select("a", "b").unionByName(near).distinct(), "pairs")
    dropped(near)
    members = found.where("bucket is not null").select("bucket", F.col("a").alias("s"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("s")).unionByName(members.select("s")).distinct()
    tags = written(nodes.join(asked, "s", "left_semi").select("tag"), "tags")
    few = F.broadcast(tags) if tags.count() <= FEW else tags
    texts = docs.select(F.xxhash64(text).alias("tag"), text_or_empty(text).alias("t")).join(few, "tag", "left_semi").select("t")
    sets = written(texts.mapInArrow(_sets(words, seed), "s long, hashes array<long>").dropDuplicates(["s"]), "hashes")
    side = lambda end: sets.select(F.col("s").alias(end), F.col("hashes").alias(f"{end}_hashes"))
    common = F.size(F.array_intersect("a_hashes", "b_hashes"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sure = written(both.where(common * of >= (F.size("a_hashes") + F.size("b_hashes") - common) * top).select("a", "b"), "links")
    for step in (pairs, tags):
        dropped(step)
    comp = components(sure, "a", "b")
    if not members.isEmpty():
        placed = members.join(comp, F.col("s") == F.col("node"), "left").select("bucket", "s", F.coalesce("component", "s").alias("c"))
        placed = written(placed.join(nodes.select("s", "n"), "s"), "members")
        # Samples often gather the same nodes: one cell of each set of nodes is enough.
        apart = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("s")).alias("who")).where("low <> high")
        apart = written(apart.groupBy("size", "who").agg(F.min_by(F.struct("bucket", "weight"), "bucket").alias("b")).select("b.bucket", "b.weight"), "apart")
        tiles = _tiles(placed.select("bucket", "s", "c"), sets, apart, tile)
        across = written(tiles.groupBy("bucket", "low", "high").applyInArrow(_across(top, of), "a long, b long"), "across")
        for step in (placed, apart):
            dropped(step)
        if not across.isEmpty():
            comp = components(sure.unionByName(across), "a", "b")
        dropped(across)
    for step in (nodes, found, sets, sure):
        dropped(step)
    return comp


def labelled(docs: DataFrame, doc_id: str, text: str, words: int, similarity: tuple[int, int], samples: int, rows: int, seed: int, small: int, tile: int, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, tag: a hash of the text, component) of each document."""
    signed = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text_or_empty(text).alias("t"))
    signed = written(signed.mapInArrow(_signed(words, seed, samples, rows), "id long, tag long, s long, f long, n int, keys array<long>"), "samples")
    comp = grouped(signed, docs, text, words, similarity, seed, small, tile, links)
    return signed.select("id", "tag", "s").join(comp, F.col("s") == F.col("node"), "left").select("id", "tag", F.coalesce("component", "s").alias("component"))
