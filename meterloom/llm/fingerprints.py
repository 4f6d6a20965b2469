"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraph digests (lines, and the sentences of a line; the n-th repeat of a paragraph has a
digest of its own). Each digest goes to one cell of three subtables, which hold a count, the XOR of digests and the XOR
of their check values. The difference of two sketches keeps only the digests in one text and not the other; peeling its
pure cells recovers them. If peeling sticks, both texts are sketched again with more cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import id_and_text

#: Cells of the sketch that a fingerprint carries, in three subtables.
CELLS = 18
#: A paragraph longer than this many characters is parted at words.
LONG = 400
#: Text bytes of one partition.
PART_BYTES = 32 << 20
#: Most partitions; their bounds and first ids are held by the driver.
MAX_PARTS = 10_000
_LAST = (1 << 63) - 1


def paragraphs(text: str) -> list[str]:
    """Lines and their sentences; what is still long is cut behind words that a rule on the word alone picks."""
    out = []
    for unit in text.replace(". ", ".\n").replace("| ", "|\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        if len(unit) <= LONG:
            out.append(unit)
            continue
        piece: list[str] = []
        for word in unit.split(" "):
            piece.append(word)
            if word and (len(word) * 31 + ord(word[-1])) % 8 == 0:
                out.append(" ".join(piece))
                piece = []
        out.append(" ".join(piece))
    return out


def digests(text: str) -> np.ndarray:
    """The distinct 64-bit paragraph digests of a text; none for an empty one."""
    if not text:
        return np.empty(0, np.uint64)
    units = paragraphs(text)
    if len(set(units)) < len(units):
        seen: Counter = Counter()
        for k, u in enumerate(units):
            if seen[u]:
                units[k] = f"{seen[u]}\n{u}"  # no paragraph holds a line break
            seen[u] += 1
    return np.unique(np.array([xxh3_64_intdigest(u) for u in units], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _check(keys: np.ndarray) -> np.ndarray:
    return (keys ^ (keys >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)


class Sketch:
    """Count, key and check of each cell."""

    __slots__ = ("check", "count", "key")

    def __init__(self, cells: int):
        self.count, self.key, self.check = np.zeros(cells, np.int32), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)

    def put(self, keys: np.ndarray, signs: np.ndarray | None = None) -> Sketch:
        """Adds digests, or takes away those of sign -1."""
        third = np.uint64(len(self.count) // 3)
        h, n = _mix(keys), len(keys)
        at = np.empty(3 * n, np.int64)
        for j in range(3):
            at[j * n : (j + 1) * n] = ((h >> np.uint64(21 * j)) & np.uint64(0x1FFFFF)) % third + np.uint64(j) * third
        check = _check(keys)
        np.add.at(self.count, at, 1 if signs is None else np.concatenate((signs, signs, signs)))
        np.bitwise_xor.at(self.key, at, np.concatenate((keys, keys, keys)))
        np.bitwise_xor.at(self.check, at, np.concatenate((check, check, check)))
        return self

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(len(self.count))
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests in the first text only and in the second only; None if the cells don't give them all."""
        plus, less = [], []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            if len(pure):
                pure = pure[self.check[pure] == _check(self.key[pure])]
            if not len(pure):
                break
            keys, first = np.unique(self.key[pure], return_index=True)
            signs = self.count[pure[first]]
            self.put(keys, -signs)
            plus.append(keys[signs > 0])
            less.append(keys[signs < 0])
        if self.count.any() or self.key.any() or self.check.any():
            return None
        none = np.empty(0, np.uint64)
        return np.concatenate([none, *plus]), np.concatenate([none, *less])

    def text(self) -> str:
        return base64.b64encode(self.count.astype("<i2").tobytes() + self.key.astype("<u8").tobytes() + self.check.astype("<u4").tobytes()).decode()


def difference(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The digests in a only and in b only: from the sketches at hand, else from larger ones, until peeling succeeds."""
    x, y = first or (Sketch(CELLS).put(a), Sketch(CELLS).put(b))
    found, cells = x.minus(y).peel(), 3 * (len(a) + len(b)) // 2 + 12  # so many hold the difference of any two such texts
    while found is None:
        cells = 3 * -(-cells // 3)
        signs = np.concatenate((np.ones(len(a), np.int32), np.full(len(b), -1, np.int32)))
        found, cells = Sketch(cells).put(np.concatenate((a, b)), signs).peel(), 2 * cells  # a sum with signs is the subtracted sketch
    return found


def likeness(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch]) -> float:
    """Shared paragraphs over all paragraphs of two texts, from the difference of their sketches; 1 for two empty texts."""
    apart = sum(map(len, difference(a, b, first)))
    both = len(a) + len(b)
    return (both - apart) / (both + apart) if both else 1.0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            s = b.slice(at, 256)
            yield from zip(*(s.column(c).to_pylist() for c in ("halo", "doc_id", "text")), strict=True)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of one range in order, the first row of the next range last: a fingerprint row for each row."""

    def described(text: str):
        d = digests(text)
        return d, Sketch(CELLS).put(d)

    def row(doc_id, text, own, following, after) -> tuple:
        d, s = own
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n] if n else text
        e, t = described(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), s.text(), t.text(), likeness(d, e, (s, t)), likeness(d, after[0], (s, after[1]))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []
    last, done = None, False
    for halo, doc_id, text in _rows(batches):
        if done:
            continue
        own = described(text)
        if last is not None:
            out.append(row(*last, text, own))
        last, done = (doc_id, text, own), halo
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    if last is not None and not done:  # nothing follows: this row is the only one there is
        out.append(row(*last, last[1], last[2]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _ranges(bounds: list[int], firsts: dict[int, int], before: dict[int, int]):
    """Adds the range of each row, and the row again, as halo, for the range before if it may be the first of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for b in batches:
            order = b.column("order_id").to_numpy(zero_copy_only=False)
            part = np.searchsorted(edges, order, "right").astype(np.int32)
            own = [b.column("order_id"), b.column("doc_id"), b.column("text")]
            names = ["order_id", "doc_id", "text", "part", "halo"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(part), pa.array(np.zeros(len(part), bool))], names)
            if not before:
                continue
            head = np.flatnonzero([firsts.get(p) == i for p, i in zip(part.tolist(), order.tolist(), strict=True)])
            if len(head):
                to = np.array([before[p] for p in part[head].tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(head)) for c in own), pa.array(to), pa.array(np.ones(len(head), bool))], names)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by the start of the next document's text; documents are in ascending
    id order (rows that repeat an id by text, rows without an id last), and the first follows the last. Null texts are
    empty: their sketch is empty, and two empty texts are alike. Texts go to range partitions once; only the first row
    of each range is sent twice. Range bounds come from an approximate percentile of the ids, one for each partition;
    there are at most `MAX_PARTS`, so what the driver holds of them is bounded, and beyond that ranges grow: a task sorts
    its range on disk where it must and reads it as a stream.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_LAST)).alias("order_id"), "doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_PARTS, max(1, -(-total // part_bytes)))
    bounds = sorted(set(rows.agg(F.percentile_approx("order_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] or [])) if n > 1 else []
    if bounds:
        ids = rows.select("order_id").mapInArrow(_part_of(bounds), "part int, order_id long")
        firsts = {r["part"]: r["first"] for r in ids.groupBy("part").agg(F.min("order_id").alias("first")).collect()}
    else:
        least = rows.agg(F.min("order_id")).first()[0]
        firsts = {} if least is None else {0: least}
    ring = sorted(firsts)
    before = {p: ring[k - 1] for k, p in enumerate(ring)}
    dealt = rows.mapInArrow(_ranges(bounds, firsts, before), "order_id long, doc_id long, text string, part int, halo boolean")
    placed = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("halo", "order_id", "text")
    return placed.mapInArrow(_fingerprinted, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _part_of(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for b in batches:
            part = np.searchsorted(edges, b.column("order_id").to_numpy(zero_copy_only=False), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column("order_id")], ["part", "order_id"])

    return run
