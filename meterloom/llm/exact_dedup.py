"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after white space is deleted. Each input task inserts its texts into a radix trie whose
terminal nodes hold an owner, so a group of copies leaves a task as one row. The distinct strings are dealt out by
length and content hash; each partition inserts them into a trie that spills subtrees beyond its memory budget, and
the owners of its terminal nodes are the rows that stay. Owners return to the documents by the SHA-256 of the
string; groups of one never take part in that join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch
from .radix import RadixTrie

#: Bytes that one task's trie may hold before it hands rows on (map side) or spills a subtree (reduce side).
TRIE_BYTES = 48 << 20


def _stripped(batch: pa.RecordBatch) -> list[bytes]:
    return [x.translate(None, WHITE) for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha = [hashlib.sha256(x).hexdigest() for x in _stripped(b)]
        points = pc.cast(pc.utf8_length(b.column("text")), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), points, pa.array(sha, pa.string())], ["doc_id", "row", "points", "text_sha256"])


def _rows(entries: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in entries], pa.binary()),
            pa.array([o[0] for _, o in entries], pa.int64()),
            pa.array([o[1] for _, o in entries], pa.int64()),
            pa.array([o[2] for _, o in entries], pa.int64()),
        ],
        ["key", "n_points", "owner", "n_rows"],
    )


def _chunks(items: Iterator, limit: int = 8 << 20) -> Iterator[list]:
    chunk, held = [], 0
    for entry in items:
        chunk.append(entry)
        held += len(entry[0]) + 64
        if held > limit:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _local_owners(trie_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for b in batches:
            for key, n, i in zip(_stripped(b), pc.utf8_length(b.column("text")).to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                trie.insert(key, (n, i, 1))
                if trie.held > trie_bytes:  # what is left of a group meets again after the shuffle
                    yield from map(_rows, _chunks(trie.items()))
                    trie = RadixTrie()
        yield from map(_rows, _chunks(trie.items()))

    return run


def _owners(trie_bytes: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(trie_bytes, folder, f"trie-{TaskContext.get().taskAttemptId()}")
        for b in batches:
            for key, n, i, rows in zip(*(b.column(c).to_pylist() for c in ("key", "n_points", "owner", "n_rows")), strict=True):
                trie.insert(key, (n, i, rows))
        for chunk in _chunks(((k, o) for k, o in trie.items() if o[2] > 1), 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(k).hexdigest() for k, _ in chunk], pa.string()),
                    pa.array([o[1] for _, o in chunk], pa.int64()),
                    pa.array([o[2] for _, o in chunk], pa.int64()),
                ],
                ["group_sha256", "owner", "n_rows"],
            )

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES, row_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    The row of a group with most code points in its original text stays, then the smallest id; a null id comes last.
    Null and empty texts, and texts of white space alone, are equal to one another. Rows that repeat one id are alike
    in every column here: they count in group_size and are kept or dropped together. A group whose rows all lack an id
    keeps none of them by `kept`, since nothing names the row. An empty table gives an empty result.

    With `row_col`, a column of whole numbers that differ between rows, these and the code points of the original text
    come as last columns `row` and `points`.
    """
    row = (docs[row_col] if row_col else F.lit(0)).cast("long").alias("row")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), row)
    local = rows.select("doc_id", "text").mapInArrow(_local_owners(trie_bytes), "key binary, n_points long, owner long, n_rows long")
    dealt = local.repartition(F.length("key"), F.xxhash64("key"))
    spills = Scratch(docs.sparkSession, "tries").folder("spilled")
    groups = dealt.mapInArrow(_owners(trie_bytes, spills), "group_sha256 string, owner long, n_rows long")
    each = rows.mapInArrow(_digests, "doc_id long, row long, points long, text_sha256 string")
    joined = each.join(groups, each.text_sha256 == groups.group_sha256, "left")
    keep = F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("owner"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n_rows", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
        *(["row", "points"] if row_col else []),
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that another row stands for; every column stays.

    Of rows with equal texts exactly one stays, also where they repeat an id or have none: the one with most code
    points, then the smallest id (null last), then the one that was read first. Null and empty texts are one group.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows, row = scratch.numbered(docs)
    found = scratch.save(exact_dedup(rows, row_col=row, **options).filter("group_size > 1").select("text_sha256", "row", "points", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("named")), "copies")
    order = F.struct(F.col("points"), (-F.col("row")).alias("late"))
    stay = found.filter("named").groupBy("text_sha256").agg(F.max(order).alias("o")).select((-F.col("o.late")).alias("stay"))
    gone = found.join(stay, found.row == stay.stay, "left_anti").select(F.col("row").alias("gone"))
    return rows.join(gone, rows[row] == gone.gone, "left_anti").select(docs.columns)
