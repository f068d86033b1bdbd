"""Hashes of words and word windows inside Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Words are looked up in a table per task, emptied when it has grown to this size.
_TABLE_SIZE = 300_000
_MASK = 0xFFFFFFFFFFFFFFFF


class WordHashes(dict):
    """64-bit hashes of words, each computed once while it stays in the table."""

    def __init__(self, seed: int = 0, fold=None):
        super().__init__()
        self._digest, self._seed, self._fold = xxhash.xxh3_64_intdigest, seed, fold

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _TABLE_SIZE:
            self.clear()
        value = self._digest(self._fold(word) if self._fold else word, self._seed)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(h: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with fewer words, none."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k, m in enumerate(multipliers(size, seed)):
        total += h[k : k + n] * m
    return mixed(total)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Distinct runs of ``size`` words, sorted; with fewer words, the whole sequence as one."""
    if 0 < len(h) < size:
        return windows(h, len(h))
    return np.unique(windows(h, size))
