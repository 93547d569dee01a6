"""URL filters by a sorted digest array.

A rule is a host and a path, `block` or `allow`. Its key is the 64-bit xxhash of the text host + path. The keys lie
sorted in a file that each executor maps into memory, beside the full strings. For a url, every host
suffix at a label's border is combined with every path prefix whose length occurs in the rules; all of a
batch's keys are looked up by one vectorised binary search, and a hit counts only if the stored string
is the same, so colliding digests do no harm. The longest fitting rule wins (of equally long ones that with the longer
host); without one a url is allowed.

The file travels by the session's file distribution, not by a shared path, once for each application and set of
rules. Null urls and urls without `://` have an empty host and path, and no rule fits them. Very long urls are matched
whole; repeated rows are judged alike; an empty table gives none; columns with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, plus

_maps: dict[str, DigestArray] = {}
_sent: dict[tuple, str] = {}


def host_of(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; '' without ://."""
    u = F.col(url) if isinstance(url, str) else url
    raw = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ?, # or the end; '' without ://."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted 64-bit keys and, in the same order, strings with their verdicts; kept in one file."""

    @staticmethod
    def write(rules: list[tuple[str, str, str]], folder: str) -> str:
        """rules: (host, path, verdict). Returns the file's path; its name says what is in it."""
        made = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"{verdict} is neither allow nor block")
            made[host.lower(), path] = verdict
        rows = sorted((xxhash.xxh64_intdigest((h + p).encode()), h + p, len(h.encode()), v == "block") for (h, p), v in made.items())
        keys = np.array([r[0] for r in rows], np.uint64)
        raw = [r[1].encode() for r in rows]
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        hosts = np.array([r[2] for r in rows], np.int32)
        block = np.array([r[3] for r in rows], np.uint8)
        lengths = np.array(sorted({len(p) for _, p in made}), np.int32)
        parts = [np.array([len(rows), len(lengths)], np.int64), keys, ends, lengths, hosts, block, np.frombuffer(b"".join(raw), np.uint8)]
        blob = b"".join(p.tobytes() for p in parts)
        at = os.path.join(folder, f"rules-{hashlib.sha256(blob).hexdigest()[:24]}.bin")
        with open(at, "wb") as f:
            f.write(blob)
        return at

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in whole[:16].view(np.int64))
        self.n, at = n, 16

        def part(kind, count):
            nonlocal at
            size = np.dtype(kind).itemsize * count
            out = whole[at : at + size].view(kind)
            at += size
            return out

        self.keys, self.ends = part(np.uint64, n), part(np.int64, n + 1)
        self.lengths, self.hosts, self.block = part(np.int32, m).tolist(), part(np.int32, n), part(np.uint8, n)
        self.strings, self.sizes = whole[at:], [h for h in np.unique(self.hosts).tolist() if h]

    def find(self, candidates: list[tuple[str, int]]) -> list[int]:
        """Of each (string, host bytes) its rule's place, -1 without one."""
        digests = np.fromiter((xxhash.xxh64_intdigest(s.encode()) for s, _ in candidates), np.uint64, len(candidates))
        first = np.searchsorted(self.keys, digests, "left")
        last = np.searchsorted(self.keys, digests, "right")
        out = [-1] * len(candidates)
        for i in np.flatnonzero(first < last).tolist():
            text, host = candidates[i]
            raw = text.encode()
            for k in range(first[i], last[i]):
                if self.hosts[k] == host and self.strings[self.ends[k] : self.ends[k + 1]].tobytes() == raw:
                    out[i] = k
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        candidates, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            raw = host.encode()
            for size in self.sizes:  # only ends as long as some rule's host can be one
                if size == len(raw) or size < len(raw) and raw[-size - 1 :][:1] == b".":
                    tail = raw[-size:].decode()
                    for n in self.lengths:
                        if n <= len(path):
                            candidates.append((tail + path[:n], size))
                            owner.append(i)
        best: list[tuple] = [(-1, -1, None, "allow")] * len(hosts)
        for i, (text, size), k in zip(owner, candidates, self.find(candidates) if candidates else [], strict=True):
            if k >= 0 and (len(text), size) > best[i][:2]:
                best[i] = (len(text), size, text, "block" if self.block[k] else "allow")
        return [b[2:] for b in best]


def shipped(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Writes the rules' file and gives it to all executors, once for each application and set of rules; returns its name there."""
    key = (spark.sparkContext.applicationId, tuple(map(tuple, rules)))
    if key not in _sent:
        path = DigestArray.write(rules, tempfile.mkdtemp(prefix="tessera-rules-"))  # the driver serves the file from there
        spark.sparkContext.addFile(path)
        _sent[key] = os.path.basename(path)
    return _sent[key]


def _judge(name: str, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _maps:
            _maps[name] = DigestArray(SparkFiles.get(name))
        rules = _maps[name]
        for batch in batches:
            found = rules.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*rest, "host", "path"]), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*rest, "host", "path", "rule", "verdict"])

    return run


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """pages without url, with host, path, rule (host + path, null: none fits) and verdict, which replace columns of these names."""
    rest = others(pages, (url,), ("host", "path", "rule", "verdict"))
    name = shipped(pages.sparkSession, rules)
    rows = pages.select(*rest, host_of(url).alias("host"), path_of(url).alias("path"))
    schema = plus(rows, rule=T.StringType(), verdict=T.StringType())
    return rows.mapInArrow(_judge(name, rest), schema)
