"""Hashed word shingles and MinHash signatures of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_CACHE_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit digests by word; starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit digests of the five-word shingles; of all words if there are fewer.

    Bytes are lower-cased and split as ASCII, which is what the contract's A-Z and
    ``[^\\x20\\x09-\\x0D]+`` mean for UTF-8.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    folded = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        folded = (folded ^ h[j : n - width + 1 + j]) * _MIX
        folded ^= folded >> np.uint64(29)
    return np.unique(folded)


def multipliers(k: int, seed: int) -> np.ndarray:
    """Odd factors; each orders the 64-bit digests in another way."""
    return np.random.default_rng(seed).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(tokens: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest product per factor, tagged with its coordinate, as signed 64-bit numbers."""
    low = np.array([(tokens * f).min() for f in factors]) if len(tokens) > 50_000 else (factors[:, None] * tokens[None, :]).min(1)
    return ((low ^ factors) * _MIX).view(np.int64)


def parity_words(tokens: np.ndarray, words: int) -> list[int]:
    """Signed 64-bit words in which a bit says whether an odd number of the tokens fall on it."""
    bits = np.uint64(1) << ((tokens >> np.uint64(8)) & np.uint64(63))
    word = tokens % np.uint64(words)
    found = [np.bitwise_xor.reduce(bits[word == np.uint64(w)], initial=np.uint64(0)) for w in range(words)]
    return np.array(found, np.uint64).view(np.int64).tolist()
