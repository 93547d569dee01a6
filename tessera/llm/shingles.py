"""Word shingles of a text and SimHash fingerprints of their hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPLIT = re.compile(rb"[\x20\x09-\x0D]+")
#: Row v: the bits of the byte v, lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(raw: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of `words` words, A-Z lower-cased and joined by one space, repeats included."""
    found = [w for w in _SPLIT.split(raw.translate(_LOWER)) if w]
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, seed)]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes).tolist(), (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)]


def fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    return of_hashes(shingle_hashes(raw, words, seed))


def of_hashes(hashes: list[int]) -> int:
    """fingerprint() of a text's shingle hashes, repeats included."""
    n = len(hashes)
    if not n:
        return 0
    each = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(each[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of hashes."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    return np.packbits(bits.sum(axis=1) * 2 > hashes.shape[1], axis=1, bitorder="little").view(np.uint64).ravel()
