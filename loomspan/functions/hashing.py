"""Word and shingle hashes for min-hash signatures, on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """A cache of 64-bit hashes of words, emptied when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[str], n: int, cache: WordHashes) -> np.ndarray:
    """A hash of every run of ``n`` words, of all words where there are fewer."""
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest("\x00" + " ".join(words))], np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    m = len(w) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m]
    h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0xD6E8FEB86659FD93))
