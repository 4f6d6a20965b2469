"""Merging Burrows-Wheeler transforms of shards by iterative interleave refinement, for use inside tasks.

The collection is a set of byte strings. A symbol is STRIDE consecutive bytes, and from each of its STRIDE residues a
string is read as a sequence of whole symbols closed by an end mark, so that every byte position is one suffix. A
shard's transform lists, for its suffixes in order, the symbol before each one, and the last-to-first map leads from a
suffix to the one that begins with that symbol.

The merge starts from an interleave that knows nothing and refines it: a stable sort of the interleaved transform by
its symbols orders all suffixes by one symbol more than before. Block borders follow the same way: two neighbours share
h + 1 symbols if they begin with one symbol and what follows lay in one block of h symbols. After DEPTH rounds a block
is an interval of common prefix of at least DEPTH * STRIDE bytes. No suffix is sorted again across shards.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

STRIDE, DEPTH = 40, 5
#: Bytes of the shared prefix that makes an interval a repeat.
WIDTH = STRIDE * DEPTH
#: Bytes of the strings of one shard.
SHARD_BYTES = 1 << 14
_ODD = np.random.default_rng(20240301).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(raw: bytes) -> np.ndarray:
    """Scrambled 8-byte words at every byte position."""
    return mixed(np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)))


def grams(w: np.ndarray, n_words: int) -> np.ndarray:
    """64-bit hashes of 8 * n_words bytes at every position, from `words`."""
    n = len(w) - 8 * (n_words - 1)
    total = w[:n] * _ODD[0]
    for k in range(1, n_words):
        total += w[8 * k : 8 * k + n] * _ODD[k]
    return mixed(total)


def _order(keys: np.ndarray) -> np.ndarray:
    """Stable order of small integers, by passes of 16 bits."""
    if keys.dtype == np.uint16:
        return np.argsort(keys, kind="stable")
    first = np.argsort((keys & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    return first[np.argsort((keys[first] >> np.uint32(16)).astype(np.uint16), kind="stable")]


class Transform:
    """The transform of one shard: suffixes in order, the symbol before each, and the last-to-first map.

    `begin` and `end` give the string of each position; its last position is that of the end mark.
    """

    def __init__(self, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray, low: int, high: int):
        at = np.arange(low, high, dtype=np.int32)
        ends = at + STRIDE >= end[low:high]  # fewer bytes than a symbol: the end mark alone
        head = at - STRIDE < begin[low:high]
        size = end[low:high] - begin[low:high] - 1
        # the suffix before: one symbol to the left; before a whole string stands its own end mark
        offset = at - begin[low:high]
        before = np.where(head, begin[low:high] + offset + ((size - offset) // STRIDE) * STRIDE, at - STRIDE)
        own = np.where(ends, 0, symbol[low:high])
        order = np.arange(high - low, dtype=np.int32)
        before -= np.int32(low)
        previous = own[before]
        for _ in range(DEPTH):  # the shard alone, by the same induced passes
            order = before[order[_order(previous[order])]]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.position = at[order]
        self.symbols = previous[order]
        self.to_first = rank[before[order]]


def merge(shards: list[Transform]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, starts): all suffixes in merged order, and where each interval of at least WIDTH shared bytes starts."""
    base = np.cumsum([0, *(len(s.position) for s in shards)])
    symbols = np.concatenate([s.symbols for s in shards])
    to_first = np.concatenate([s.to_first + np.int32(b) for s, b in zip(shards, base[:-1], strict=True)])
    position = np.concatenate([s.position for s in shards])
    interleave, block = np.arange(len(position), dtype=np.int32), np.zeros(len(position), np.int32)
    for _ in range(DEPTH):
        read = symbols[interleave]
        order = _order(read)
        first, inner = read[order], block[order]
        border = np.empty(len(order), bool)
        border[0] = True
        np.not_equal(inner[1:], inner[:-1], out=border[1:])
        border[1:] |= first[1:] != first[:-1]
        interleave, block = to_first[interleave[order]], np.cumsum(border, dtype=np.int32) - 1
    return position[interleave], np.flatnonzero(border)


class Repeats:
    """Which windows of WIDTH bytes of weighted strings repeat: the weights of the strings that hold one add up to 2."""

    def __init__(self, strings: list[bytes], weights: list[int]):
        sizes = np.array([len(s) + 1 for s in strings])  # one place for the end mark
        upto = np.cumsum(sizes).astype(np.int32)
        sizes = sizes.astype(np.int32)
        begin, end = np.repeat(upto - sizes, sizes), np.repeat(upto, sizes)
        raw = b"\0".join(strings) + b"\0"
        self.hash = grams(words(raw + bytes(STRIDE + 8)), STRIDE // 8)[: len(raw)]
        _, symbol = np.unique(self.hash, return_inverse=True)
        symbol = (symbol + 1).astype(np.uint16 if len(_) < 65_535 else np.uint32)
        cuts = [0]
        for u in upto.tolist():
            if u - cuts[-1] >= SHARD_BYTES or u == len(raw):
                cuts.append(u)
        self.position, starts = merge([Transform(symbol, begin, end, a, z) for a, z in zip(cuts, cuts[1:], strict=False)])
        self.begin, self.whole = upto - sizes, end - np.arange(len(raw)) > WIDTH
        inside = self.whole[self.position]
        each = np.repeat(np.asarray(weights, np.int64), sizes)[self.position]
        total = np.add.reduceat(np.where(inside, each, 0), starts)
        count = np.diff(np.append(starts, len(self.position)))
        repeated = np.zeros(len(raw), bool)
        repeated[self.position] = np.repeat(total >= 2, count) & inside
        self.repeated, self.sizes = repeated, sizes
        self.heads = self.position[starts[(total >= 2)]]

    def covered(self) -> list[np.ndarray]:
        """For each string the (start, end) pairs, flat, of bytes under repeated windows."""
        flags = np.concatenate(([False], self.repeated, [False]))
        edge = np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2)  # a string's last windows are never whole: runs don't cross
        edge[:, 1] += WIDTH - 1
        at = np.searchsorted(self.begin, edge[:, 0], "right") - 1
        edge -= self.begin[at][:, None]
        return np.split(edge.ravel(), 2 * np.searchsorted(at, np.arange(1, len(self.sizes))))

    def window_hash(self, positions: np.ndarray) -> np.ndarray:
        total = self.hash[positions] * _ODD[8]
        for k in range(1, DEPTH):
            total += self.hash[positions + k * STRIDE] * _ODD[8 + k]
        return mixed(total)
