"""Words and 5-word shingles of a text as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Words in a shingle.
WIDTH = 5
_MASK = (1 << 64) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """Hash of each word seen by a task; starts again when it has grown large."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text lower-cased in A-Z; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < WIDTH:
        own = np.uint64(len(h))
        for x in h:
            own = np.uint64((int(own) * 0x100000001B3 + int(x)) & _MASK)
        return mixed(np.array([own]))
    n = len(h) - WIDTH + 1
    s = h[:n] * _ODD[0]
    for k in range(1, WIDTH):
        s += h[k : k + n] * _ODD[k]
    return np.unique(mixed(s))
