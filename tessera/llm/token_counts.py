"""Token counts of byte-level BPE by rank-synchronous merging.

The distinct pre-tokens of a batch lie in one ragged array of symbols. In every step each sequence finds the lowest
rank among its pairs, and all sequences merge theirs at once; a merge's rank is above those of its parts, so all
places of a sequence's lowest pair can go together, from the left where they overlap. Only pairs beside a merge
are looked up anew, by binary search. A sequence without a ranked pair is done, and what is left of it is counted.

Pre-tokens come from the library's own splitter (its pattern, where all is ASCII), over the distinct chunks of a batch; a task keeps the counts of up to
`most` chunks. A special token's string in a text is one token, and cuts the text, as the library has it.

Null texts are empty and have no tokens. Very long texts and pre-tokens are handled whole (a pre-token of n symbols takes
a pass over what is left of it for each different rank it merges). Repeated rows are counted alike, an empty table gives
none, columns with a result's name are replaced, and the others are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import byte_level, byte_letters, chunks_of, some_at_once
from .common import fresh, others, plus, text_or_empty

#: The splitter's pattern where all is ASCII; the library itself splits the rest.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
NONE = np.int32(np.iinfo(np.int32).max)
_counters: dict[tuple[str, int], Counter] = {}


class Merges:
    """Symbols of bytes, ranks of pairs and what they become."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = np.argsort(key).astype(np.int32)
        self.key = key[self.rank]
        letters = byte_letters()
        self.symbol = np.zeros(1 + max(map(ord, letters)), np.int64)
        for letter, byte in letters.items():
            self.symbol[ord(letter)] = vocab[letter]
            if byte < 0x80:  # ASCII may stand for itself: no letter lies there but its own
                self.symbol[byte] = vocab[letter]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Of each word (its bytes as letters, or ASCII) the number of symbols left when no pair has a rank."""
        out = np.array([len(w) for w in words], np.int64)
        of = np.flatnonzero(out)
        size = out[of]
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        rank = np.full(len(symbols), NONE)  # of the pair that begins here; none at the end of a sequence
        inner = np.ones(len(symbols), bool)
        inner[np.cumsum(size) - 1] = False
        look = np.flatnonzero(inner)
        rank[look] = self.ranks(symbols[look], symbols[look + 1])
        while len(of):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            going = least < NONE
            if not going.all():  # the others are done
                out[of] = size
                stays = np.repeat(going, size)
                symbols, rank, of, size, least = symbols[stays], rank[stays], of[going], size[going], least[going]
                continue
            at = np.flatnonzero(rank == np.repeat(least, size))
            # A pair of equal symbols may overlap its neighbour: of a run of places every other one is taken.
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            size = size - np.bincount(np.searchsorted(start, at, side="right") - 1, minlength=len(size))
            place = at - np.arange(len(at))  # where the merged symbols are now
            inner = np.ones(len(symbols), bool)
            inner[np.cumsum(size) - 1] = False
            rank[place] = NONE
            look = np.concatenate([place, place[place > 0] - 1])
            look = look[inner[look]]
            rank[look] = self.ranks(symbols[look], symbols[look + 1])
        return out


class Counter:
    """Token counts of distinct chunks."""

    def __init__(self, file: str, most: int = 300_000, longest: int = 40):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        byte_level(spec)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.split = Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.most, self.longest, self.table = most, longest, {}

    def learn(self, chunks: list[str]) -> None:
        """Counts of new chunks, by way of their distinct pre-tokens."""
        places: dict[str, int] = {}
        of, word = [], []
        total = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            parts = [chunk]
            if self.special and (found := self.special.findall(chunk)):
                parts, total[i] = self.special.split(chunk), len(found)
            for part in parts:
                for piece in _ASCII.findall(part) if part.isascii() else [p for p, _ in self.split(part)]:
                    of.append(i)
                    word.append(places.setdefault(piece, len(places)))
        if word:
            total += np.bincount(of, self.merges.counts(list(places))[word], len(chunks)).astype(np.int64)
        self.table.update(zip(chunks, total.tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.table) > self.most:
            self.table.clear()
        split = [chunks_of(t) for t in texts]
        new = list({c for chunks in split for c in chunks} - self.table.keys())
        self.learn(new)
        get = self.table.__getitem__
        out = [sum(map(get, chunks)) for chunks in split]
        for c in new:
            if len(c) > self.longest:
                del self.table[c]
        return out


def counter_of(file: str, most: int) -> Counter:
    """The worker's counter for a tokenizer."""
    key = (file, most)
    if key not in _counters:
        _counters[key] = Counter(file, most)
    return _counters[key]


def counted(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024, most: int = 300_000) -> DataFrame:
    """docs with text replaced by n_bytes, n_tokens and over_limit (more than `limit` tokens); tokenizer is the path of a .json file."""
    rest, t = others(docs, (text,), ("n_bytes", "n_tokens", "over_limit")), fresh(docs, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer, most)
        for batch in batches:
            texts = batch.column(t)
            n = pa.array([x for part in some_at_once(texts.to_pylist()) for x in counter.counts(part)], pa.int64())
            made = [pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*rest, text_or_empty(text).alias(t)).mapInArrow(run, plus(docs.select(*rest), n_bytes=T.LongType(), n_tokens=T.LongType(), over_limit=T.BooleanType()))
