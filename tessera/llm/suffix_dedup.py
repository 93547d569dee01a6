"""Suffix-array dedup: find and cut byte strings of `length` or more that occur elsewhere, in or across documents.

A suffix array over 100 TB can't be one array, so suffixes are first dealt into buckets that need no
others. In every window of `length` bytes the smallest hash of a `gram`-byte string marks an anchor
(ties: the leftmost), so equal windows have equal anchors at equal offsets, and each window belongs
to exactly one anchor. A row an anchor, about one in 80 bytes, is all that is shuffled of a text
without repeats.

1. An anchor whose gram occurs once has no repeated window. The others send their context, all bytes
   of all their windows. Contexts are grouped by these bytes: one that occurs again has only repeated windows.
2. What is left, the contexts at the ends of repeated passages, goes into the bucket of its gram, one
   of each kind. There the suffixes are sorted by a mergesort that compares by prefix polynomial hashes
   and binary search for the common extension, rightwards from the anchor and, with the bytes reversed,
   leftwards. A window is repeated if the common extensions of neighbours cover it. Windows that both
   orders allow but no neighbour covers are sorted as suffixes themselves, where an equal one is a neighbour.
3. A bucket of more than `bucket` contexts is split by further bytes: windows that begin nearer to the
   anchor share more bytes behind it, the others more before it, so each half of the windows has longer
   keys. Each half is a bucket like any other, and is split again until small or a single window wide.

Hashes only propose. Orders and extensions are confirmed on the bytes (an order that fails is sorted anew
by the bytes), and keys that collide only put strangers into one bucket.

Null texts are empty, texts under `length` bytes lose nothing, repeated rows are documents of their
own that repeat each other, an empty table gives none. Very long texts are read in blocks of 65,536 windows.
Other columns don't matter; remove_repeats hands them on.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, text_or_empty, written

BASE = 0x9E3779B97F4A7C55
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept, and grown by doubling."""
    key = hex(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.ones(max(1 << 17, 1 << (n - 1).bit_length()), np.uint64)
        have[1] = base
        done = 2
        while done < len(have):
            step = np.uint64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _powers[key] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of data[i] * BASE**i for s <= i < e, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE), out=out[1:])
    return out


def windows_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], whatever the place."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), BASE_INVERSE)[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: from each block's running minima to the left and to the right."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, x.max(), x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


#: Windows of a text that are looked at together, and the bits that hold a place among their grams.
BLOCK, PLACE_BITS = 1 << 16, np.uint64(17)


def _block_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    w = length - gram + 1
    p = prefix_hashes(data)
    grams = mixed((p[gram:] - p[:-gram]) * powers(len(p), BASE_INVERSE)[: len(p) - gram])
    keys = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, w)
    cut = np.flatnonzero(least[1:] != least[:-1])
    first = np.concatenate([[0], cut + 1])
    last = np.concatenate([cut, [len(least) - 1]])
    place = (least[first] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    return place, grams[place], first, last


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: its place, its gram's hash, and the first and last of its windows (they follow each other).

    A choice depends on nothing but the window: the upper 47 bits of its grams' hashes, then the place.
    """
    found = []
    for at in range(0, len(data) - length + 1, BLOCK):
        place, grams, first, last = _block_anchors(data[at : at + BLOCK + length - 1], length, gram)
        place, first, last = place + at, first + at, last + at
        if found and found[-1][0][-1] == place[0]:  # an anchor's windows go on in the next block
            found[-1][3][-1] = last[0]
            place, grams, first, last = place[1:], grams[1:], first[1:], last[1:]
        if len(place):
            found.append((place, grams, first, last))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0]


# ---------------------------------------------------------------- the bucket's suffix array


def common(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes a and b, up to most, as far as hashes tell: never too short."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = windows_hashes(prefix, a, a + mid) == windows_hashes(prefix, b, b + mid)
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def confirmed(data: np.ndarray, a: np.ndarray, b: np.ndarray, claimed: np.ndarray) -> np.ndarray:
    """Common extensions by the bytes, of what hashes claim."""
    out = claimed.copy()
    order = np.argsort(claimed, kind="stable")  # those of like length together
    for part in np.array_split(order, max(1, int(claimed.sum()) >> 20)):
        if len(part) and (wide := int(claimed[part].max())):
            span = np.arange(wide)
            inside = span < claimed[part][:, None]
            other = (data[np.minimum(a[part][:, None] + span, len(data) - 1)] != data[np.minimum(b[part][:, None] + span, len(data) - 1)]) & inside
            wrong = other.any(axis=1)
            out[part[wrong]] = other[wrong].argmax(axis=1)
    return out


def extensions(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    return confirmed(data, a, b, common(data, prefix, a, b, most))


def suffix_sort(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end] by group, then content; and each one's common extension with the one before it (0 in another group).

    A mergesort from the bottom up over all groups at once: every element finds its place in the sibling
    run by binary search, and one comparison takes a logarithmic number of hash look-ups. Where hashes that
    collide send two suffixes to one place, or the bytes show neighbours in the wrong order, the group is sorted by its bytes.
    """
    prefix, n = prefix_hashes(data), len(start)
    order = np.argsort(group, kind="stable")
    _, counts = np.unique(group[order], return_counts=True)
    base = np.repeat(np.cumsum(counts) - counts, counts)  # where the group begins
    size = np.repeat(counts, counts)
    at = np.arange(n) - base
    width, failed = 1, np.zeros(n, bool)  # failed: places of groups that comparisons didn't order
    while n and width < counts.max():
        run = at // width
        sibling = run ^ 1
        low = np.minimum(sibling * width, size)
        high = np.minimum(low + width, size)
        first, after = low.copy(), (run & 1).astype(bool)  # of equal ones, those of the left run come first
        mine = order
        while (active := np.flatnonzero(low < high)).size:
            mid = (low[active] + high[active]) >> 1
            x, y = mine[active], order[base[active] + mid]
            room = np.minimum(end[x] - start[x], end[y] - start[y])
            k = common(data, prefix, start[x], start[y], room)
            more = k < room
            cx = np.where(more, data[np.minimum(start[x] + k, len(data) - 1)].astype(np.int64), (end[x] - start[x]) - k)
            cy = np.where(more, data[np.minimum(start[y] + k, len(data) - 1)].astype(np.int64), (end[y] - start[y]) - k)
            before = (cy < cx) | ((cy == cx) & after[active])  # the sibling's element comes before mine
            low[active] = np.where(before, mid + 1, low[active])
            high[active] = np.where(before, high[active], mid)
        place = base + (run & ~1) * width + (at - run * width) + (low - first)
        twice = np.bincount(place, minlength=n) != 1
        if twice.any():
            failed |= np.isin(base, base[twice])
        place = np.where(failed, base + at, place)  # a failed group stays as it is
        out = order.copy()
        out[place] = order
        order, width = out, width * 2

    def by_bytes(bases: np.ndarray) -> None:
        for b in np.unique(bases).tolist():
            i = np.flatnonzero(base == b)
            order[i] = sorted(order[i].tolist(), key=lambda z: data[start[z] : end[z]].tobytes())

    by_bytes(base[failed])
    while True:
        lcp = np.zeros(n, np.int64)
        same = np.flatnonzero(group[order[1:]] == group[order[:-1]])
        x, y = order[same], order[same + 1]
        room = np.minimum(end[x] - start[x], end[y] - start[y])
        k = lcp[same + 1] = extensions(data, prefix, start[x], start[y], room)
        # An order is right if each neighbour is.
        at_x, at_y = (data[np.minimum(start[z] + k, max(0, len(data) - 1))] for z in (x, y))
        bad = np.where(k < room, at_x > at_y, end[x] - start[x] > end[y] - start[y])
        if not bad.any():
            return order, lcp
        by_bytes(base[same[bad]])


def farthest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Of each suffix, its longest common extension with any other of its group: that with a neighbour."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]) if len(lcp) else lcp)
    return out


def repeated_windows(buffers: list[bytes], left: np.ndarray, weight: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (context, a, b) of repeated windows in contexts of weight 1, of some whole groups of distinct contexts.

    Buffer i has its anchor at byte left[i]; its windows begin `s` bytes before that, for s from its least to left[i].
    """
    data = np.frombuffer(b"".join(buffers), np.uint8)
    sizes = np.array([len(b) for b in buffers], np.int64)
    begin = np.cumsum(sizes) - sizes
    anchor, nearest = begin + left, left - (sizes - length)
    turned = data[::-1]
    ways = []
    for text, start, end in ((data, anchor, begin + sizes), (turned, len(data) - anchor, len(data) - begin)):
        ways.append((text, prefix_hashes(text), start, end, *suffix_sort(text, start, end, group)))
    low = np.maximum(nearest, length - farthest(*ways[0][4:]))
    high = np.minimum(left, farthest(*ways[1][4:]))
    low = np.where(weight > 1, high + 1, low)

    # What each context has in common with its neighbours in either order: windows from s = length - right to s = left.
    spans: list[tuple[np.ndarray, ...]] = []
    for way, (_, _, _, _, order, lcp) in enumerate(ways):
        at = np.flatnonzero(lcp) if len(lcp) else lcp
        x, y = order[at - 1], order[at]
        text, prefix, start, end = ways[1 - way][:4]
        across = extensions(text, prefix, start[x], start[y], np.minimum(end[x] - start[x], end[y] - start[y]))
        right, back = (lcp[at], across) if way == 0 else (across, lcp[at])
        for z in (x, y):
            spans.append((z, np.maximum(low[z], length - right), np.minimum(high[z], back)))
    of, a, b = map(np.concatenate, zip(*spans, strict=True))
    keep = a <= b
    of, a, b = of[keep], a[keep], b[keep]

    # Windows within both bounds that no neighbour covers.
    n = np.maximum(0, high - low + 1)
    base = np.cumsum(n) - n
    edges = np.zeros(n.sum() + 1, np.int64)
    np.add.at(edges, base[of] + a - low[of], 1)
    np.add.at(edges, base[of] + b - low[of] + 1, -1)
    open_ = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    if len(open_):
        of2, s2 = _sorted_windows(data, ways[0][1], anchor, group, length, np.repeat(np.arange(len(n)), n)[open_], open_, base, low, nearest, left)
        of, a, b = np.concatenate([of, of2]), np.concatenate([a, s2]), np.concatenate([b, s2])
    return of, left[of] - b, left[of] - a + length


def _sorted_windows(data, prefix, anchor, group, length, context, open_, base, low, nearest, left) -> tuple[np.ndarray, np.ndarray]:
    """Those of the open windows that equal another window of their group: windows of a group and a place are sorted, equal ones are neighbours."""
    s = open_ - base[context] + low[context]
    wanted = np.unique(np.stack([group[context], s], 1), axis=0)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    members = {g: np.flatnonzero(group == g) for g in np.unique(wanted[:, 0]).tolist()}
    todo: list[tuple[np.ndarray, int]] = []
    have = 0

    def settle() -> None:
        of = np.concatenate([m for m, _ in todo])
        at = np.concatenate([np.full(len(m), x) for m, x in todo])
        kind = np.concatenate([np.full(len(m), i) for i, (m, _) in enumerate(todo)])
        start = anchor[of] - at
        key = mixed(windows_hashes(prefix, start, start + length) + kind.astype(np.uint64) * MIX)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        some = count[which] > 1  # equal windows have equal hashes
        of, at, kind, start = of[some], at[some], kind[some], start[some]
        if len(of):
            order, lcp = suffix_sort(data, start, start + length, kind)
            same = np.flatnonzero(lcp == length)
            hit = np.unique(np.concatenate([order[same], order[same - 1]]))
            hits.append((of[hit], at[hit]))

    for g, x in wanted.tolist():
        m = members[g]
        m = m[(nearest[m] <= x) & (x <= left[m])]
        todo.append((m, x))
        have += len(m)
        if have > 100_000:
            settle()
            todo, have = [], 0
    if todo:
        settle()
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, at = map(np.concatenate, zip(*hits, strict=True))
    mine = np.isin(of * 1024 + at, context * 1024 + s)
    return of[mine], at[mine]


# ---------------------------------------------------------------- Spark


def _anchor_rows(length: int, gram: int, key_bits: int):
    digest, drop = xxhash.xxh3_64_intdigest, 64 - key_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], 0

            def made() -> pa.RecordBatch:
                doc, *rest = (pa.array(np.concatenate(c)) for c in zip(*out, strict=True))  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column("k1").take(doc), batch.column("k2").take(doc), *rest], ["k1", "k2", "gram", "context", "place"])  # noqa: B023

            for i, text in enumerate(batch.column("t")):
                raw = memoryview(text.as_buffer())
                at, grams, first, last = anchors(np.frombuffer(raw, np.uint8), length, gram)
                if len(at):
                    context = np.fromiter((digest(raw[a : b + length], p - a) >> drop for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(at))
                    out.append((np.full(len(at), i), grams.view(np.int64), context.view(np.int64), first << 20 | (last - first) << 10 | (at - first)))
                    rows += len(at)
                if rows >= 50_000:
                    yield made()
                    out, rows = [], 0
            if out:
                yield made()

    return run


def _context_rows(length: int):
    """The contexts of anchors whose grams repeat, cut out of their documents."""
    kinds = [*[pa.int64()] * 6, pa.binary()]
    names = ["k1", "k2", "gram", "context", "first", "left", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            cols: list[list] = [[] for _ in kinds]
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)  # noqa: B023, E731
            for i, (text, todo) in enumerate(zip(batch.column("t"), batch.column("todo"), strict=True)):
                raw, todo = memoryview(text.as_buffer()), todo.values
                for gram, context, place in zip(*(todo.field(x).to_pylist() for x in ("gram", "context", "place")), strict=True):
                    first, more, left = place >> 20, place >> 10 & 1023, place & 1023
                    for c, v in zip(cols, (k1[i], k2[i], gram, context, first, left, bytes(raw[first : first + more + length])), strict=True):
                        c.append(v)
                if len(cols[0]) >= 20_000:
                    yield made()
                    cols = [[] for _ in kinds]
            if cols[0]:
                yield made()

    return run


def _bucket_rows(length: int, rows_at_once: int):
    """Settles the buckets of a sorted partition, some whole groups at a time."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, key, first, left, raw, weight = zip(*rows, strict=True)
        group = np.unique(np.array(key, np.int64), return_inverse=True)[1]
        of, a, b = repeated_windows(list(raw), np.array(left, np.int64), np.array(weight, np.int64), group, length)
        first = np.array(first, np.int64)[of]
        cols = [pa.array([k1[i] for i in of.tolist()], pa.int64()), pa.array([k2[i] for i in of.tolist()], pa.int64()), pa.array(first + a), pa.array(first + b)]
        return pa.RecordBatch.from_arrays(cols, ["k1", "k2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, len(batch), rows_at_once):
                part = batch.slice(at, rows_at_once)
                rows += zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "key", "first", "left", "bytes", "weight")), strict=True)
                if len(rows) >= rows_at_once:
                    last = rows[-1][2]
                    keep = next((i for i in range(len(rows), 0, -1) if rows[i - 1][2] != last), 0)  # the last group may go on
                    if keep:
                        yield settle(rows[:keep])
                        rows = rows[keep:]
        if rows:
            yield settle(rows)

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with the keys k1, k2: the id and a hash of the text, so that rows with one id but other texts stay apart."""
    return docs.withColumns({"k1": F.col(doc_id).cast("long"), "k2": F.xxhash64(text_or_empty(text))})


def joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs and rows with the same keys."""
    rows = rows.withColumnsRenamed({"k1": "r1", "k2": "r2"})
    return docs.join(rows, F.col("k1").eqNullSafe(F.col("r1")) & (F.col("k2") == F.col("r2")), how).drop("r1", "r2")


def source_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k1, k2, t): the keys and the whole text. Both joins with texts take these rows, so Spark shuffles the texts once."""
    return keyed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), "id", "t").select("k1", "k2", text_or_empty("t").alias("t"))


def _classes(contexts: DataFrame) -> DataFrame:
    """One row of contexts that are the same in all bytes, with their number. Of a single one, the columns are its own."""
    own = [F.max(c).alias(c) for c in ("k1", "k2", "first")]
    return contexts.groupBy("key", "left", "bytes", "lo", "hi").agg(F.sum("weight").alias("weight"), *own)


def _halves(contexts: DataFrame, length: int) -> DataFrame:
    """Each context as two: its windows that begin lo to mid bytes before the anchor, and those from mid + 1 to hi, with the bytes that all of these share as key."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("lo").alias("l"), mid.alias("h")), F.struct((mid + 1).alias("l"), F.col("hi").alias("h"))))
    out = contexts.select("*", half.alias("part")).select("*", "part.l", "part.h")
    out = out.withColumn("far", F.least("h", "left")).where(F.greatest("l", F.col("left") - F.octet_length("bytes") + length) <= F.col("far"))
    near = F.greatest(F.col("l"), F.col("left") - F.octet_length("bytes") + length)
    shared = F.substring(F.col("bytes"), (F.col("left") - F.col("l") + 1).cast("int"), (F.col("l") - F.col("h") + length).cast("int"))
    own = F.substring(F.col("bytes"), (F.col("left") - F.col("far") + 1).cast("int"), (F.col("far") - near + length).cast("int"))
    return out.select(F.xxhash64("key", "l", shared).alias("key"), "k1", "k2", (F.col("first") + F.col("left") - F.col("far")).alias("first"), F.col("far").alias("left"), own.alias("bytes"), "weight", F.col("l").alias("lo"), F.col("h").alias("hi"))


def _unsettled(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets that hold a context of weight 1, as (key, contexts), and those contexts with their partners."""
    # Sums are written before they are joined: a join right above a sum can't split its hot keys.
    spread = written(classes.groupBy("key").agg(F.count("*").alias("contexts"), F.min("weight").alias("least")).where("least = 1 and contexts > 1").select("key", "contexts"), "spread")
    return spread, classes.join(spread, "key")


def _bucket_spans(classes: DataFrame, length: int, bucket: int, own: list[DataFrame]) -> list[DataFrame]:
    """(k1, k2, a, b) of what is repeated in contexts of weight 1; tables to drop go into own."""
    spans = []
    while True:
        spread, contexts = _unsettled(classes)
        own.append(spread)
        cols = ["key", "k1", "k2", "first", "left", "bytes", "weight"]
        cool = contexts.where(F.col("contexts") <= bucket).select(*cols)
        spans.append(cool.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_rows(length, bucket), "k1 long, k2 long, a long, b long"))
        hot = contexts.where((F.col("contexts") > bucket) & (F.col("lo") < F.col("hi"))).drop("contexts")
        if spread.where(F.col("contexts") > bucket).isEmpty():
            return spans
        halves = written(_halves(hot, length), "halves")
        classes = written(_classes(halves), "classes")
        own += [halves, classes]
        # Windows of weight 1 that are the same as another's in their half.
        same = ["key", "left", "bytes"]
        twice = halves.where("weight = 1").join(classes.where("weight > 1").select(*same), same, "left_semi")
        spans.append(twice.select("k1", "k2", F.col("first").alias("a"), (F.col("first") + F.octet_length("bytes")).alias("b")))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, gram: int = 40, bucket: int = 1000, key_bits: int = 64) -> DataFrame:
    """One row (k1, k2, spans) for each keyed() document with bytes to remove: byte ranges [a, b), which may overlap.

    key_bits: the bits of a context's hash; fewer give the same result with more collisions to tell apart.
    """
    if not gram <= length < 1024:
        raise ValueError("gram <= length < 1024 is needed")
    source = source_rows(docs, doc_id, text)
    rows = written(source.where(F.octet_length("t") >= length).mapInArrow(_anchor_rows(length, gram, key_bits), "k1 long, k2 long, gram long, context long, place long"), "anchors")
    again = written(rows.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    found = written(rows.join(again, "gram"), "found")
    dropped(rows)
    dropped(again)
    todo = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "context", "place")).alias("todo"))
    contexts = joined(source, todo, "inner").mapInArrow(_context_rows(length), "k1 long, k2 long, gram long, context long, first long, left long, bytes binary")
    kinds = ["gram", "context", "left", "bytes"]
    classes = written(contexts.groupBy(*kinds).agg(F.count("*").alias("weight"), *(F.max(c).alias(c) for c in ("k1", "k2", "first"))), "classes")
    own = [found, classes]
    # A context goes by the hash of its bytes where it is told that others are the same; where hashes of other bytes collide, by the bytes.
    key = ["gram", "context"]
    clash = written(classes.groupBy(*key).count().where("count > 1").select(*key), "clash")
    many = classes.where("weight > 1").select(*key, "weight")
    clear = clash.isEmpty()
    many = written(many if clear else many.join(clash, key, "left_anti"), "many")
    own += [clash, many]
    # Contexts that hold over a thousandth of all are fewer than a thousand, whatever the input: they are broadcast.
    heavy = F.col("weight") > max(1, found.count() // 1000)
    first, span = F.shiftright("place", 20), ["k1", "k2", "first", "n"]
    members = found.select("k1", "k2", *key, first.alias("first"), (F.shiftright("place", 10).bitwiseAND(1023) + length).alias("n"))
    marked = members.join(F.broadcast(many.where(heavy).select(*key, F.lit(True).alias("heavy"))), key, "left")
    light = marked.where("heavy is null").join(many.where(~heavy).select(*key), key)
    settled = marked.where("heavy").select(*span).unionByName(light.select(*span))
    if not clear:
        twice = classes.where("weight > 1").join(clash, key, "left_semi").select(*kinds)
        settled = settled.unionByName(contexts.join(twice, kinds, "left_semi").select("k1", "k2", "first", F.octet_length("bytes").alias("n")))
    spans = [settled.select("k1", "k2", F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))]
    wide = classes.withColumnRenamed("gram", "key").drop("context").withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    spans += _bucket_spans(wide, length, bucket, own)
    out = written(functools.reduce(DataFrame.unionByName, spans).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    for step in own:
        dropped(step)
    return out


def _kept(raw: bytes, spans: list | None) -> tuple[list[tuple[int, int]], bytes]:
    cut = merge_spans([(x["a"], x["b"]) for x in spans or ()])
    edges = [0, *(x for span in cut for x in span), len(raw)]
    return cut, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("t"), batch.column("spans"), strict=True):
            raw = text.as_buffer().to_pybytes()
            cut, kept = _kept(raw, spans.as_py())
            out.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
        n, removed, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, **more) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null text counts as empty; a null id stays null."""
    full = joined(source_rows(docs, doc_id, text), repeated_spans(docs, doc_id, text, length, **more), "left")
    full = full.select(F.col("k1").alias("doc_id"), "t", "spans")
    return full.mapInArrow(_digest_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the spans cut out of `text`; the other columns pass as they are."""

    def one(t: pa.Scalar, spans: list) -> str:
        raw = t.as_buffer().to_pybytes()
        cut = []
        for a, b in merge_spans([(x["a"], x["b"]) for x in spans]):
            while a < b and raw[a] & 0xC0 == 0x80:  # a character that is only partly covered stays
                a += 1
            while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                b -= 1
            cut.append({"a": a, "b": b})
        return _kept(raw, cut)[1].decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, whole = batch.column(batch.num_columns - 1), batch.columns[:-1]
            at = batch.schema.names.index(text)
            where = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False) & whole[at].is_valid().to_numpy(zero_copy_only=False))
            if len(where):
                made = pa.array([one(whole[at][i], spans[i].as_py()) for i in where.tolist()], pa.string())
                take = np.full(len(batch), -1)
                take[where] = np.arange(len(where))
                cut = pa.array(take, mask=take < 0)
                whole[at] = pc.coalesce(made.take(cut), whole[at].cast(pa.string()))
            yield pa.RecordBatch.from_arrays(whole, batch.schema.names[:-1])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, **more) -> DataFrame:
    """docs with repeated strings cut out of text, whole characters only; the other columns and rows stay. Null texts stay null."""
    spans = repeated_spans(docs, doc_id, text, length, **more)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called, none clashes with the keys
    rows = keyed(docs.toDF(*names.values()), names[doc_id], names[text])
    full = joined(rows, spans, "left").select(*names.values(), "spans")
    kind = T.StructType([T.StructField(names[f.name], f.dataType) for f in docs.schema.fields])
    return full.mapInArrow(_without(names[text]), kind).toDF(*docs.columns)
