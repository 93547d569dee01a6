"""SimHash near-dedup: fingerprints of shingles, joined by a grid over segment bit counts.

A fingerprint's embedding is the vector of the bit counts of its 32 two-bit segments. Flipping a
bit moves one count by one, so the Manhattan distance of two embeddings is a lower bound of the
Hamming distance of the fingerprints. Counts 0, 1, 2 are kept as 00, 01, 11 in one 64-bit word:
the Manhattan distance is then the bit count of an exclusive or.

The grid cuts the 32 coordinates into `distance` + `spare` blocks. Embeddings at Manhattan distance
`distance` differ in so many blocks at most, so they share a cell in the grid over some `spare`
blocks: each fingerprint goes into one cell for each choice of them. Pairs of a cell must pass the
Manhattan bound and then the exact Hamming distance. Texts with one fingerprint are one node; only
distinct fingerprints go into cells. `spare` grows with their number, so cells stay small. A large cell gives a
spanning forest of its links instead of all of them: its components are the same, and its links are fewer than its
members. A very large cell is cut further by the blocks it doesn't fix, on the same ground.

one_of_each() with a `similarity` lets the shingle sets decide on these links, and on those of samples (simhash_similar).

Words are runs of non-white space with A-Z lower-cased. Null and wordless texts have the fingerprint
zero, linked like any other; texts of fewer words than a shingle are one shingle; a very long text is
held whole, about 60 bytes a word, in one task. A null id never names a group unless all ids of the group are null.
Repeated rows are members of their group. An empty table gives none. Columns may have any names; one_of_each() keeps them all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_similar
from .common import dropped, fresh, text_or_empty, written
from .components import components
from .shingles import fingerprint

EVEN = 0x5555555555555555


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(x, words, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(prints)], ["id", "tag", "f"])

    return run


def embedded(f: str):
    """The segment bit counts of fingerprint column f, two bits each: 00, 01 or 11."""
    x = F.col(f)
    high = F.shiftrightunsigned(x, 1)
    return x.bitwiseOR(high).bitwiseAND(EVEN).bitwiseOR(F.shiftleft(x.bitwiseAND(high).bitwiseAND(EVEN), 1))


def grid_masks(distance: int, spare: int) -> list[int]:
    """Of each choice of `spare` blocks, the embedding's bits that make the cell, as signed 64-bit numbers."""
    blocks = [sum(3 << 2 * i for i in part.tolist()) for part in np.array_split(np.arange(32), distance + spare)]
    masks = (sum(x) for x in itertools.combinations(blocks, spare))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning(prints: np.ndarray, marks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within `distance` connect, at most one less than there are fingerprints.

    marks: their embeddings. Whatever a fingerprint reaches first leaves the rest, so a dense group costs a few
    passes over it and no group gives more links than members.
    """
    ends: list[list[np.ndarray]] = [[], []]
    while len(prints) > 1:
        frontier = [(prints[0], marks[0])]
        prints, marks = prints[1:], marks[1:]
        while frontier and len(prints):
            p, m = frontier.pop()
            near = np.flatnonzero(np.bitwise_count(marks ^ m) <= distance)
            near = near[np.bitwise_count(prints[near] ^ p) <= distance]
            if len(near):
                ends[0].append(np.full(len(near), p))
                ends[1].append(prints[near])
                frontier += zip(prints[near], marks[near], strict=True)
                rest = np.ones(len(prints), bool)
                rest[near] = False
                prints, marks = prints[rest], marks[rest]
    return tuple(np.concatenate(e) if e else np.zeros(0, np.uint64) for e in ends)


def within(prints: np.ndarray, marks: np.ndarray, distance: int, free: int, full: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """spanning() of a cell of any size: above `full` members, the segments that the cell doesn't fix (`free`: their bits) are cut into
    distance + 1 blocks, one of which any two embeddings within the distance share."""
    segments = [3 << 2 * i for i in range(32) if free >> 2 * i & 1]
    if len(prints) <= full or len(segments) <= distance:
        return spanning(prints, marks, distance)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for block in np.array_split(np.arange(len(segments)), distance + 1):
        mask = sum(segments[i] for i in block.tolist())
        key = marks & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                ends.append(within(prints[order[a:b]], marks[order[a:b]], distance, free & ~mask, full))
    return tuple(np.concatenate(e) if ends else np.zeros(0, np.uint64) for e in (zip(*ends, strict=True) if ends else ((), ())))


def _links(masks: list[int], distance: int, small: int = 24):
    """Links of each cell of a sorted partition: all of a small cell's, a spanning forest of a larger one's."""

    def settle(t: np.ndarray, cell: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = f.view(np.uint64)
        high = f >> np.uint64(1)
        marks = ((f | high) & np.uint64(EVEN)) | ((f & high) & np.uint64(EVEN)) << np.uint64(1)
        cut = np.flatnonzero((t[1:] != t[:-1]) | (cell[1:] != cell[:-1])) + 1
        first = np.concatenate([[0], cut])
        sizes = np.diff(np.append(first, len(f)))
        out = [within(f[a : a + n], marks[a : a + n], distance, ~masks[t[a]] & (1 << 64) - 1) for a, n in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True)]
        run, of = np.repeat(np.arange(len(first)), sizes), np.repeat(sizes, sizes)
        for step in range(1, small):
            a = np.flatnonzero((run[step:] == run[:-step]) & (of[step:] <= small))
            if not len(a):
                break
            a = a[np.bitwise_count(marks[a] ^ marks[a + step]) <= distance]
            a = a[np.bitwise_count(f[a] ^ f[a + step]) <= distance]
            out.append((f[a], f[a + step]))
        return tuple(np.concatenate(x) if out else np.zeros(0, np.uint64) for x in zip(*out, strict=True)) if out else (f[:0], f[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = settle(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["fa", "fb"])

        for batch in batches:
            rows = tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "cell", "f"))
            if not len(rows[0]):
                continue
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last cell, which may go on, begins
            if held and (held[-1][0][-1] != rows[0][0] or held[-1][1][-1] != rows[1][0]):
                yield emit(tuple(map(np.concatenate, zip(*held, strict=True))))
                held = []
            if last:
                held.append(tuple(c[:last] for c in rows))
                yield emit(tuple(map(np.concatenate, zip(*held, strict=True))))
                held = []
            held.append(tuple(c[last:] for c in rows))
        if held:
            yield emit(tuple(map(np.concatenate, zip(*held, strict=True))))

    return run


def spare_blocks(n: int) -> int:
    """Blocks that make a cell, so that n distinct fingerprints are some to a cell: 3 up to 2 ** 24, 4, 5 and 6 beyond."""
    return 3 + sum(n > 1 << bits for bits in (24, 28, 31))


def links(prints: DataFrame, f: str = "f", distance: int = 4, spare: int | None = None) -> DataFrame:
    """(fa, fb): links between distinct fingerprints at Hamming distance 1 to `distance` that connect whatever all such links connect."""
    distinct = prints.select(F.col(f).alias("f")).distinct()
    found = grid_masks(distance, spare or spare_blocks(distinct.count()))
    masks = F.array(*(F.lit(m).cast("long") for m in found))
    cells = distinct.select("f", embedded("f").alias("e")).select("f", "e", F.posexplode(masks).alias("t", "m"))
    cells = cells.select("t", F.col("e").bitwiseAND(F.col("m")).alias("cell"), "f")
    return cells.repartition("t", "cell").sortWithinPartitions("t", "cell").mapInArrow(_links(found, distance), "fa long, fb long")


def labelled(docs: DataFrame, doc_id: str, text: str, words: int, distance: int, seed: int) -> DataFrame:
    """(id, tag: a hash of the text, f: its fingerprint, component, component_id) of each document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text_or_empty(text).alias("t"))
    rows = written(rows.mapInArrow(_fingerprints(words, seed), "id long, tag long, f long"), "fingerprints")
    nodes = written(rows.groupBy("f").agg(F.min("id").alias("least")), "nodes")
    comp = components(links(nodes, "f", distance), "fa", "fb")
    # A component's name comes from ids, not from fingerprints: the least id over its nodes.
    named = written(nodes.join(comp, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("component", "f").alias("component")), "named")
    dropped(nodes)
    # Sums are written before they are joined: a join right above a sum can't split its hot keys.
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    return rows.join(named.join(least, "component").select("f", "component", "component_id"), "f", "left")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """A row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    out = labelled(docs, doc_id, text, words, distance, seed)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def least_rows(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with one row left of each component of rows (id, tag, component)."""
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("best"))
    key = fresh(docs, "id_key")
    named = lambda i, tag: F.concat_ws(":", i.cast("string"), tag.cast("string"))
    kept = docs.withColumn(key, named(F.col(doc_id).cast("long"), F.xxhash64(text)))
    kept = kept.join(best.select(named(F.col("best.id"), F.col("best.tag")).alias(key)), key, "left_semi")
    if not any("map<" in kind for _, kind in docs.dtypes):
        least = F.min(F.struct(*docs.columns))
    else:  # maps have no order, their texts have
        least = F.min_by(F.struct(*docs.columns), F.struct(*(F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes)))
    return kept.groupBy(key).agg(least.alias(f"{key}_row")).select(f"{key}_row.*")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, distance: int = 4, seed: int = 42, similarity: tuple[int, int] | None = None, samples: int = 20, rows: int = 4, small: int = 24, tile: int = 2_000_000) -> DataFrame:
    """docs with one row left of each group, that with the smallest id (null ids last, then by text hash and row); all columns stay.

    Groups are linked by fingerprints within `distance`, or, with a `similarity` such as (4, 5), by the Jaccard similarity of the shingle
    sets of texts that are so linked or share a cell of samples, for which samples, rows, small and tile are simhash_similar's.
    """
    if similarity:
        found = simhash_similar.labelled(docs, doc_id, text, words, similarity, samples, rows, seed, small, tile, lambda prints: links(prints, "f", distance))
    else:
        found = labelled(docs, doc_id, text, words, distance, seed)
    return least_rows(docs, found, doc_id, text)
