"""64-bit hashes of words and of runs of words, the same on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashing a word takes less than looking up its hash among all others."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, run: int) -> np.ndarray:
    """The hash of each ``run`` consecutive words."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, run):
        out *= _MULTIPLIER
        out += hashes[k : k + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(30)
    return out
