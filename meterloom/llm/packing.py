"""Hierarchical multi-length packing of token ids into training sequences.

Whole long windows are cut off each document; the rest is routed to the smallest context tier that holds it. Windows
are packed from the longest tier down: the longest open rest opens a window of its tier, the best-fitting shorter rests
fill its gap, and when none fits, the shortest one is cut so that the window is exactly full. What is left of a block
of documents opens the next block; a task's last window is cut into powers of two, so nothing is padded. A task packs
its own documents in blocks of bounded tokens, so no text is shuffled. All sequences of a tier are then ranked by
attention cost over the whole corpus, by a range sort of narrow rows, and dealt into step groups, heaviest first in
serpentine order.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_and_text
from .tokens import encoder

TIERS = (256, 512, 1024, 2048)
#: Ids of the documents that are packed together.
BLOCK_IDS = 1 << 21
#: Sequences of a step group.
GROUP = 32

#: A part of a document: (length, document, start).
Part = tuple[int, int, int]


def pack(parts: list[Part], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Part]], list[Part]]:
    """Sequences of parts, each as long as a tier, and the parts that are left over; with `last`, these become sequences
    of a power of two each and none is left."""
    longest, done, rests = tiers[-1], [], []
    for n, doc, start in parts:
        whole = n // longest
        done += [[(longest, doc, start + k * longest)] for k in range(whole)]
        if n % longest:
            rests.append((n % longest, doc, start + whole * longest))
    rests.sort()
    left: list[Part] = []
    while rests:
        first = rests.pop()
        window, gap = [first], next(t for t in tiers if t >= first[0]) - first[0]
        while gap and rests:
            k = bisect_right(rests, (gap, 1 << 62, 0)) - 1
            if k >= 0:
                part = rests.pop(k)
            else:
                n, doc, start = rests.pop(0)
                part = (gap, doc, start)
                insort(rests, (n - gap, doc, start + gap))
            window.append(part)
            gap -= part[0]
        if gap:
            left = window
        else:
            done.append(window)
    if last and left:
        done += powers_of_two(left)
        left = []
    return done, left


def powers_of_two(parts: list[Part]) -> list[list[Part]]:
    """The parts, in order, cut into sequences whose lengths are the powers of two of their sum."""
    total, out, queue = sum(p[0] for p in parts), [], list(reversed(parts))
    while total:
        room, sequence = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            n, doc, start = queue.pop()
            take = min(n, room)
            sequence.append((take, doc, start))
            if n > take:
                queue.append((n - take, doc, start + take))
            room -= take
        out.append(sequence)
    return out


def with_step_groups(pieces: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """`pieces` with step_group: the sequences of a tier, by falling attention cost, in serpentine order over its groups.

    Ranks come from a range sort and the numbers of rows before each range, so no task orders more than its share.
    """
    costs = pieces.groupBy("sequence_id", "tier").agg(F.sum(F.col("length") * F.col("length")).alias("cost"))
    order = [F.col("tier"), F.desc("cost"), F.col("sequence_id")]
    ordered = scratch.save(costs.repartitionByRange(*order).sortWithinPartitions(*order).select("sequence_id", "tier", F.monotonically_increasing_id().alias("at")), "sequences")
    part = F.shiftright("at", 33)
    runs = ordered.groupBy("tier", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("tier").orderBy("part")
    runs = runs.select("tier", "part", "first", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tier")).alias("all"))
    ranked = ordered.withColumn("part", part).join(runs, ["tier", "part"]).withColumns({"rank": F.col("before") + F.col("at") - F.col("first"), "groups": F.ceil(F.col("all") / group)})
    at = F.col("rank") % F.col("groups")
    own = F.when(F.floor(F.col("rank") / F.col("groups")) % 2 == 0, at).otherwise(F.col("groups") - 1 - at)
    return pieces.join(ranked.select("sequence_id", (F.shiftleft(F.col("tier").cast("long"), 40) + own).alias("step_group")), "sequence_id")


COLUMNS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "tier": pa.int32()}


def _packer(tokenizer: str, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        next_sequence = 0
        docs: dict[int, tuple[int | None, np.ndarray]] = {}
        parts: list[Part] = []
        held, n_docs = 0, 0

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal next_sequence, parts, held
            done, left = pack(parts, last=last)
            rows: list[list] = [[] for _ in COLUMNS]
            bodies = []
            for k, sequence in enumerate(done):
                offset, tier = 0, sum(p[0] for p in sequence)
                for n, doc, start in sequence:
                    doc_id, ids = docs[doc]
                    body = ids[start : start + n]
                    for column, x in zip(rows, (doc_id, start, n, zlib.crc32(body), len(ids), task + next_sequence + k, offset, tier), strict=True):
                        column.append(x)
                    if with_ids:
                        bodies.append(body.tolist())
                    offset += n
            next_sequence += len(done)
            kept = {doc for _, doc, _ in left}
            for doc in [d for d in docs if d not in kept]:
                del docs[doc]
            parts, held = left, sum(p[0] for p in left)
            arrays = [pa.array(c, t) for c, t in zip(rows, COLUMNS.values(), strict=True)]
            names = [*COLUMNS]
            if with_ids:
                arrays.append(pa.array(bodies, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for at in range(0, len(ids), 256):
                texts = b.column("text").slice(at, 256).to_pylist()
                for doc_id, x in zip(ids[at : at + 256], encoder(tokenizer, end_id).encode(texts), strict=True):
                    docs[n_docs] = (doc_id, np.ascontiguousarray(x, "<u4"))
                    parts.append((len(x), n_docs, 0))
                    n_docs, held = n_docs + 1, held + len(x)
                if held >= BLOCK_IDS:
                    yield from packed(last=False)
        yield from packed(last=True)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group and, with
    `with_ids`, the ids.

    Each id of each row of `docs` lies in exactly one piece; rows that repeat an id are packed as often. A null or empty
    text is its end id alone. The pieces of a sequence follow one another from offset 0; a sequence is as long as a tier
    or another power of two. An empty table gives an empty result.
    """
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int" + ", ids array<long>" * with_ids
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(id_and_text(docs, id_col, text_col).mapInArrow(_packer(tokenizer, end_id, with_ids), shape), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    return with_step_groups(pieces, scratch).select(*columns, *["ids"] * with_ids)
