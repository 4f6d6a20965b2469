"""Suffix-array deduplication: bytes under 200-byte strings that start more than once in the corpus.

Every 200-byte window has an anchor, the least hash among its 32-byte grams, leftmost on ties; equal windows have equal
anchors at equal places, so only windows of one anchor hash can be equal. A run of windows with one anchor occurrence is
a context of at most 368 bytes. Anchors that occur once are done. Equal contexts collapse into one class with a weight
before anything is shuffled twice. The classes of an anchor are a group; groups are dealt out by anchor, each task
builds Burrows-Wheeler transforms of shards of its strings and merges them by iterative interleave refinement, and the
intervals of at least 200 shared bytes are the repeats. A group of very many classes is dealt out in blocks, and the
intervals of its blocks meet by their hashes. Results return to documents by (anchor, context).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, id_and_text
from .interleave import WIDTH, Repeats, grams, words

GRAM = 32
SPAN = WIDTH - GRAM + 1
#: Bytes looked at together; a longer text is cut into pieces that share WIDTH - 1 bytes.
PIECE = 1 << 17
_LOW = np.uint64((1 << 20) - 1)
#: Classes of one anchor that one block holds.
BLOCK = 4096
#: Bytes of the strings that are merged together, whole groups at a time.
BATCH = 56_000


def contexts(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of the contexts of concatenated pieces that end at `ends`."""
    if len(raw) < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = grams(words(raw), GRAM // 8)
    at = np.arange(len(h), dtype=np.uint64)
    least = (h & ~_LOW) | at
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    lengths = np.diff(ends, prepend=0)
    valid = np.flatnonzero(np.arange(WIDTH, WIDTH + len(least)) <= np.repeat(ends, lengths)[: len(least)])
    if not len(valid):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    anchor = (least[valid] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))))
    return valid[first], np.diff(np.append(first, len(valid))), h[anchor[first]].view(np.int64)


_CONTEXT = "anchor long, ctx long, doc_id long, row long, at int, n int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        group: list[tuple[int, int, bytes]] = []
        held = 0
        for k, t in enumerate(texts):
            for at in range(0, max(0, len(t) - WIDTH + 1), PIECE - WIDTH + 1):
                piece = t[at : at + PIECE]
                if held + len(piece) > PIECE:
                    yield _described(b, group)
                    group, held = [], 0
                group.append((k, at, piece))
                held += len(piece)
        if group:
            yield _described(b, group)


def _described(b: pa.RecordBatch, group: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    raw = b"".join(p for _, _, p in group)
    ends = np.cumsum([len(p) for _, _, p in group])
    first, n, anchor = contexts(raw, ends)
    piece = np.searchsorted(ends, first, "right")
    view = memoryview(raw)
    ctx = np.array([xxh3_64_intdigest(view[s:e]) for s, e in zip(first.tolist(), (first + n + WIDTH - 1).tolist(), strict=True)], np.uint64).view(np.int64)
    at = first - np.concatenate(([0], ends))[piece] + np.array([a for _, a, _ in group])[piece]
    of = pa.array(np.array([k for k, _, _ in group])[piece])
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor), pa.array(ctx), b.column("doc_id").take(of), b.column("row").take(of), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
        ["anchor", "ctx", "doc_id", "row", "at", "n"],
    )


def _class_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The string of each class that a document stands for."""
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        wanted = b.column("wanted")
        counts = np.diff(wanted.offsets.to_numpy())
        flat = wanted.flatten()
        at, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("at", "n"))
        of = np.repeat(np.arange(len(texts)), counts)
        strings = [texts[k][a : a + m + WIDTH - 1] for k, a, m in zip(of.tolist(), at.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(flat.field(k) for k in ("anchor", "ctx", "weight", "blocks")), pa.array(strings, pa.binary())], ["anchor", "ctx", "weight", "blocks", "string"]
        )


_MERGED = "anchor long, ctx long, covered array<int>, window long, at int"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, block): the covered bytes of each class; of groups in blocks also their windows."""
    rows: dict[tuple, tuple] = {}
    held, last = 0, None

    def out() -> Iterator[pa.RecordBatch]:
        keys = [*rows]
        strings, weights = [r[0] for r in rows.values()], [r[1] for r in rows.values()]
        found = Repeats(strings, weights)
        anchor, ctx = [k[0] for k in keys], [k[1] for k in keys]
        names = ["anchor", "ctx", "covered", "window", "at"]
        none = pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ctx), pa.array(found.covered(), pa.list_(pa.int32())), *none], names)
        hot = np.array([r[2] > 1 for r in rows.values()])
        if hot.any():
            of = np.repeat(np.arange(len(keys)), found.sizes)
            single = np.flatnonzero(found.whole & ~found.repeated & hot[of])
            heads = found.heads[hot[of[found.heads]]]
            for part, known in ((single, True), (heads, False)):
                k = of[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(anchor)[k], pa.int64()),
                        pa.array(np.array(ctx)[k], pa.int64()) if known else pa.nulls(len(k), pa.int64()),
                        pa.nulls(len(k), pa.list_(pa.int32())),
                        pa.array(found.window_hash(part).view(np.int64)),
                        pa.array((part - found.begin[k]).astype(np.int32)),
                    ],
                    names,
                )

    for b in batches:
        for anchor, ctx, weight, blocks, block, string in zip(*(b.column(c).to_pylist() for c in ("anchor", "ctx", "weight", "blocks", "block", "string")), strict=True):
            if held >= BATCH and (anchor, block) != last:
                yield from out()
                rows, held = {}, 0
            if (anchor, ctx) not in rows:
                rows[anchor, ctx] = (string, weight, blocks)
                held += len(string)
            last = (anchor, block)
    if rows:
        yield from out()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        spans = b.column("spans")
        offsets = spans.offsets.to_numpy()
        flat = spans.values
        s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("s", "e"))
        known = spans.is_valid().to_numpy(zero_copy_only=False)
        removed, runs, sums = [], [], []
        for k, t in enumerate(texts):
            a, z = int(offsets[k]), int(offsets[k + 1])
            if not known[k] or a == z:
                removed.append(0), runs.append(0), sums.append(hashlib.sha256(t).hexdigest())
                continue
            order = np.argsort(s[a:z], kind="stable")
            begin, reach = s[a:z][order], np.maximum.accumulate(e[a:z][order])
            new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
            stop = reach[np.append(new[1:] - 1, len(reach) - 1)]
            kept, at = hashlib.sha256(), 0
            for x, y in zip(begin[new].tolist(), stop.tolist(), strict=True):
                kept.update(t[at:x])
                at = y
            kept.update(t[at:])
            removed.append(int((stop - begin[new]).sum())), runs.append(len(new)), sums.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, spans) of the documents that have any repeated 200-byte string; spans are (s, e) byte pairs that may
    overlap. `docs` has doc_id, text and row, a hash of both."""
    spark = docs.sparkSession
    every = scratch.save(docs.mapInArrow(_contexts, _CONTEXT), "contexts")
    groups = every.groupBy("anchor").agg(F.count("*").alias("rows"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).filter("rows > 1")
    repeated = scratch.save(groups.select("anchor", (F.col("c1") == F.col("c2")).alias("single")), "repeated")  # written, so that a hot anchor's join can be split
    again = scratch.save(every.join(repeated, "anchor"), "again")
    scratch.drop("contexts", "repeated")
    several = again.filter("not single")
    classes = scratch.save(several.groupBy("anchor", "ctx").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "row", "at", "n")).alias("rep")), "classes")
    sizes = classes.groupBy("anchor").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    sized = classes.join(sizes, "anchor", "left").select("anchor", "ctx", "weight", F.coalesce("blocks", F.lit(1)).alias("blocks"), "rep.*")
    wanted = sized.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "ctx", "weight", "blocks", "at", "n")).alias("wanted"))
    owners = docs.join(wanted.withColumnRenamed("doc_id", "__id").withColumnRenamed("row", "__row"), (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    strings = owners.select("text", "wanted").mapInArrow(_class_texts, "anchor long, ctx long, weight long, blocks int, string binary")
    dealt = strings.withColumn("block", F.pmod(F.xxhash64("ctx"), F.col("blocks")).cast("int")).repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    merged = scratch.save(dealt.mapInArrow(_merged, _MERGED), "merged")
    scratch.drop("classes")
    pair = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    cover = merged.filter("covered is not null and size(covered) > 0").select("anchor", "ctx", F.transform(F.sequence(F.lit(0), F.size("covered") - 2, F.lit(2)), lambda k: pair(F.get("covered", k), F.get("covered", k + 1))).alias("cover"))
    windows = merged.filter("window is not null")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("anchor", "window")
    met = windows.filter("ctx is not null").join(twice, ["anchor", "window"]).select("anchor", "ctx", F.array(pair(F.col("at"), F.col("at") + WIDTH)).alias("cover"))
    found = several.drop("single").join(cover.union(met), ["anchor", "ctx"]).select("doc_id", "row", F.transform("cover", lambda c: pair(F.col("at") + c.s, F.col("at") + c.e)).alias("part"))
    whole = again.filter("single").select("doc_id", "row", F.array(pair(F.col("at"), F.col("at") + F.col("n") + (WIDTH - 1))).alias("part"))
    return whole.union(found).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("part")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty; texts under 200 bytes lose nothing. Rows that repeat an id and text count as occurrences of
    their own; rows without an id are treated like any others. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = scratch.save(repeated_spans(rows, scratch, block), "spans").withColumnRenamed("doc_id", "__id").withColumnRenamed("row", "__row")
    scratch.drop("again", "merged")
    joined = rows.join(spans, (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
