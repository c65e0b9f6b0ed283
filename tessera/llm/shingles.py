"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_MIX = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that scatters every bit."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0] * U(2 * salt + 1)
        x = (x ^ (x >> U(30))) * _MIX[1]
        x = (x ^ (x >> U(27))) * _MIX[2]
        return x ^ (x >> U(31))


_kept: dict = {}


def kept(name: str, make):
    """What a worker remembers under ``name``, made where it is missing; one memory at a time, so those of earlier steps go."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a limit of bytes; forgetting changes no hash."""

    #: bytes of an entry besides the word's own
    ENTRY = 200

    def __init__(self, limit_bytes: int = 80 << 20):
        super().__init__()
        self.limit = self.left = limit_bytes

    def __missing__(self, word) -> int:
        self.left -= len(word) + self.ENTRY
        if self.left < 0:
            self.clear()
            self.left = self.limit
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows, in place order; none when there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U)
    out = mix(hashes[:m], n)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out ^ (hashes[k : k + m] + _MIX[k % 3]), k)
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; fewer words: the whole sequence as one; no words: empty."""
    if not len(hashes):
        return np.empty(0, U)
    return np.unique(grams(hashes, min(n, len(hashes))))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
