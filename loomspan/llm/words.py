"""Words, word hashes and shingles, shared by the operators of this subpackage.

A word is an unbroken run of letters or digits of the lower-cased text.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    """A cache of 64-bit hashes of words, emptied when it has grown too large."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


np.seterr(over="ignore")  # hashes wrap


def hash_words(lists: list[list[str]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all lists in one array, and the length of each list."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    get = cache.__getitem__
    flat = np.fromiter((h for ws in lists for h in map(get, ws)), np.uint64, int(n.sum()))
    return flat, n


def ngram_hashes(flat: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, list number and start within the list of every run of ``k`` consecutive words."""
    total = len(flat)
    if total < k:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    m = total - k + 1
    acc = np.zeros(m, np.uint64)
    for j in range(k):  # polynomial over the mixed word hashes; the place of a word matters
        acc = acc * _C3 + mix(flat[j : j + m] + _C1 * np.uint64(j + 1))
    owner = np.repeat(np.arange(len(n)), n)
    starts = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else np.empty(0, np.int64)
    ok = owner[:m] == owner[k - 1 :]
    owner = owner[:m][ok]
    return mix(acc[ok] ^ _C2), owner, np.nonzero(ok)[0] - starts[owner]
