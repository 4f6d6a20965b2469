"""Token ids of many texts, with the tokenizers library, for use inside tasks.

Encoding is a map over pre-token pieces, so each distinct piece is encoded by the library once per worker. Pieces of
ordinary texts (ASCII and Latin letters up to U+024F, no apostrophe) are found with array operations over the bytes of
many texts at a time; all other texts go to the library whole, those that hold the string of an added token (such as
an end-of-text mark) among them. Either way the ids are those of the library's plain call.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: Bytes of text that are looked at together; a longer text goes to the library whole.
CHUNK = 1 << 20
#: Distinct pieces that a worker remembers before it starts again.
PIECES = 900_000
_SLOTS = 1 << 21
_BASE = 0x2545F4914F6CDD1D
#: Bytes that need the library: NUL, the separators U+001C-1F, the apostrophe, leads of U+0080-BF and of U+0250 up.
_HARD = re.compile(rb"[\x00\x1c-\x1f'\xc2\xca-\xff]|\xc3\x97|\xc3\xb7|\xc4\xb0|\xc9[\x90-\xbf]")
_SPACE, _LETTER, _DIGIT, _MARK, _END = 0, 1, 2, 3, 4


@cache
def _classes() -> np.ndarray:
    kind = np.full(256, _MARK, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = kind[128:] = _LETTER
    kind[0] = _END
    return kind


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n = 2 * CHUNK + 16
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class PieceEncoder:
    """Ids of texts under one tokenizer file; `words` says that it lower-cases and drops white space."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix") or ""
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.words, self.end_id = bool(suffix), end_id
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token) - len(suffix) * (bool(suffix) and token.endswith(suffix))
        self._reset()

    def _reset(self) -> None:
        self.keys, self.value = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.count, self.n = np.zeros(PIECES + 300_000, np.int64), np.zeros(PIECES + 300_000, np.int64), 0

    # hash table -------------------------------------------------------------------------------------------------
    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        slot = (keys >> np.uint64(43)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.value[slot[left[hit]]]
            left = left[~hit & (there != 0)]
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)
        return out

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys >> np.uint64(43)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = keys[left[free]]
            mine = self.keys[slot[left]] == keys[left]
            self.value[slot[left[mine]]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n, m = len(counts), len(ids)
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + m] = ids
        self.first[self.n : self.n + n] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + n] = counts
        at = np.arange(self.n, self.n + n, dtype=np.int32)
        self.used, self.n = self.used + m, self.n + n
        return at

    # pieces -----------------------------------------------------------------------------------------------------
    def _pieces(self, b: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, end markers included."""
        before = np.concatenate(([np.uint8(_END)], kind[:-1]))
        if self.words:
            start = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT) | (kind == _END))
            stop = np.concatenate((start[1:] | (kind[1:] == _SPACE), [True]))
            ends = np.flatnonzero(stop & (kind != _SPACE)) + 1
            return np.flatnonzero(start), ends
        after = np.concatenate((kind[1:], [np.uint8(_END)]))
        white = kind == _SPACE
        joined = np.concatenate(([False], b[:-1] == 32)) & (kind != _END)
        start = np.where(white, (before != _SPACE) | ((after != _SPACE) & (after != _END)), ((kind != before) | (kind == _END)) & ~joined)
        starts = np.flatnonzero(start)
        return starts, np.concatenate((starts[1:], [len(b)]))

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of pieces. Those that can't run together are joined, and cut apart by the bytes of the tokens."""
        texts = [p.decode() for p in pieces]
        joint = [k for k, p in enumerate(pieces) if self.words or (p[:1] == b" " and len(p) > 1)]
        alone = [k for k in range(len(pieces)) if not (self.words or (pieces[k][:1] == b" " and len(pieces[k]) > 1))]
        of: list[np.ndarray | None] = [None] * len(pieces)
        gap = " " if self.words else ""
        groups = [joint[i : i + 200] for i in range(0, len(joint), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([gap.join(texts[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(self.token_bytes[ids]) if len(ids) else np.zeros(0, np.int64)
            cut = np.searchsorted(ends, np.cumsum([len(pieces[k]) for k in group])) + 1
            for k, a, z in zip(group, np.concatenate(([0], cut[:-1])), cut, strict=True):
                of[k] = ids[a:z]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False), strict=True):
            of[k] = np.array(e.ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *of]), np.array([len(x) for x in of], np.int64)

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"\0".join(texts) + b"\0"
        b = np.frombuffer(raw, np.uint8)
        kind = _classes()[b]
        starts, ends = self._pieces(b, kind)
        power, inverse = _powers()
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)))
        key = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key |= np.uint64(1)
        if self.n > PIECES:
            self._reset()
        at = self._find(key)
        if (at < 0).any():
            missing = np.flatnonzero(at < 0)
            fresh, where = np.unique(key[missing], return_index=True)
            which = missing[where]
            is_end = kind[starts[which]] == _END
            for ids, counts, keys in (
                (np.array([self.end_id], np.uint32), np.array([1]), fresh[is_end]),
                (*self._encode_pieces([raw[s:e] for s, e in zip(starts[which[~is_end]], ends[which[~is_end]], strict=True)]), fresh[~is_end]),
            ):
                if len(keys):
                    self._put(keys, self._add(ids, counts))
            at[missing] = self._find(key[missing])
        counts = self.count[at]
        upto = np.cumsum(counts)
        flat = self.flat[np.repeat(self.first[at] - (upto - counts), counts) + np.arange(upto[-1])]
        closed = upto[kind[starts] == _END]
        return flat, np.diff(closed, prepend=0)

    # texts ------------------------------------------------------------------------------------------------------
    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, its end id last."""
        out: list[np.ndarray | None] = [None] * len(texts)
        chunk, where, held = [], [], 0

        def flush() -> None:
            nonlocal chunk, where, held
            if chunk:
                ids, counts = self._chunk(chunk)
                for k, x in zip(where, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out[k] = x
            chunk, where, held = [], [], 0

        end = np.array([self.end_id], np.uint32)
        for k, text in enumerate(texts):
            raw = (text.lower() if self.words else text).encode()
            if len(raw) > CHUNK or _HARD.search(raw) or (self.added and self.added.search(text)):
                out[k] = np.concatenate((np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32), end))
                continue
            if held + len(raw) > CHUNK:
                flush()
            chunk.append(raw)
            where.append(k)
            held += len(raw) + 1
        flush()
        return out  # type: ignore[return-value]


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, end_id: int) -> PieceEncoder:
    """The worker's encoder for a file, kept between tasks."""
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]
