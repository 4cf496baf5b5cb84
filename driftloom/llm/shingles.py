"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

SHINGLE = 5
#: Fixed odd multipliers of the words of a shingle.
ODD = np.array([mix(np.array([i], np.uint64), 77)[0] | np.uint64(1) for i in range(64)], np.uint64)


class WordCodes(dict):
    """Word to 64-bit hash; forgets all when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of `size` codes; of the whole if it is shorter (none if empty)."""
    n = min(size, len(codes))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        total += codes[j : len(codes) - n + 1 + j] * ODD[j]
    return mix(total, n)


def shingle_set(data: bytes, codes: WordCodes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, A-Z lower-cased."""
    return np.unique(window_hashes(codes.of(data.lower().split()), size))
