"""Word shingles of whole texts as sorted arrays of 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_ENTRIES = 50_000
CHUNK = 16_384


class WordHashes(dict):
    """The 64-bit hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


WORDS = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z lower-cased, words split at ASCII white space.

    Fewer words than n make one shingle of all; no words make an empty array.
    """
    words = (text or "").encode().lower().split()  # of bytes, these touch ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    count = len(h) - width + 1
    out = np.full(count, np.uint64(width))
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + count]
        out = _mixed(out)
    return np.unique(out)


class MinHash:
    """`size` minima of one set under random linear permutations of 32-bit hashes."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, size, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, size, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """Big-endian, so that bytes sort as numbers do; all ones for an empty set."""
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), CHUNK):
            np.minimum(least, (x[None, at : at + CHUNK] * self.a + self.b).min(1), out=least)
        return least.astype(">u4")
