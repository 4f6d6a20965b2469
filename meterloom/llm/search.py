"""Ranked lexical search of many items at once: what their term sets share is added up once for each document.

The items' terms, frequent ones first, are sequences whose common runs become rules (`grammar`): a rule is a set of terms
that several items share, made of two smaller ones, so items, rules and terms form a DAG. For a block of documents each
term's scores are laid out once, each rule's accumulator is the sum of its two parts', made once, and an item's scores
are the sum of what is left of it. Each task keeps the best documents of each item; those meet in two steps.

A null text has no terms. Documents of one id are told apart by row, a null id comes after all others; every row of
`items` is an item of its own, one without terms has no result. Texts are read in pieces, so that a very long one costs
its own size. Equal scores come by id, equal rows are interchangeable. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_and_text
from .grammar import Rules, compress

#: Bytes that belong to terms stay, A-Z as a-z; all others part terms.
TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))

#: Terms of all items of a block, which a task holds; bytes of a piece of a text; numbers of a block of scores.
BLOCK_TERMS, PIECE, CELLS = 1 << 18, 4 << 20, 1 << 22
ROUNDS, PER_ROUND = 8, 512
#: Parts that the best documents of an item are dealt over before they meet.
SALTS = 64


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text, read in pieces that end between terms."""
    if len(text) <= PIECE:
        return Counter(text.translate(TERM).split())
    counts: Counter = Counter()
    text = text.translate(TERM)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        counts.update(text[at:end].split())
        at = end
    return counts


def _terms(items: DataFrame, text_col: str) -> DataFrame:
    """(row, term, n) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts = term_counts(text or b"")
                names = list(counts)
                for k in range(0, len(names), 1 << 16):
                    some = names[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(some, pa.binary()), pa.array([counts[t] for t in some], pa.int64())], ["row", "term", "n"])

    return items.select("row", F.col(text_col)).mapInArrow(run, "row long, term binary, n long")


def _postings(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document that has terms: all its terms counted, those of the items listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for begin in range(0, batch.num_rows, 256):
                ids, sizes, terms, tfs = [], [], [], []
                for doc, text in zip(batch.column(0).slice(begin, 256).to_pylist(), texts.slice(begin, 256).to_pylist(), strict=True):
                    counts = term_counts(text)
                    if counts:
                        known = [(k, n) for t, n in counts.items() if (k := index.get(t)) is not None]
                        ids.append(doc)
                        sizes.append(sum(counts.values()))
                        terms.append([k for k, _ in known])
                        tfs.append([n for _, n in known])
                arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best(weights: np.ndarray, rules: Rules, items: list[tuple[int, list[int]]], n_docs: int, n_terms: int, k: int):
    """Each task's best documents of each item, from postings."""
    first = len(weights)
    height = first + len(rules)
    width = max(1, min(1024, CELLS // max(1, height)))
    rows = [row for row, _ in items]
    parts = [np.array(s, np.int64) for _, s in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]  # heaps of (score, -id), least first
        floor = np.zeros(len(items), np.int64)
        last = np.full(len(items), np.iinfo(np.int64).min)  # the id that an equal score has to beat
        for batch in batches:
            for begin in range(0, batch.num_rows, width):
                part = batch.slice(begin, width)
                ids = part.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                n = part.column("n").to_numpy(zero_copy_only=False)
                lists, tfs = part.column("terms"), part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                term = lists.flatten().to_numpy(zero_copy_only=False)
                m = 25 + (75 * n * n_docs) // n_terms
                acc = np.zeros((height, len(ids)), np.int64)
                acc[term, doc] = weights[term] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
                for at, (left, right) in enumerate(rules, first):
                    np.add(acc[left], acc[right], out=acc[at])
                for at, symbols in enumerate(parts):
                    score = acc[symbols].sum(axis=0)
                    hits = np.flatnonzero((score > floor[at]) | ((score == floor[at]) & (ids < last[at])))
                    heap = best[at]
                    for d in hits:
                        entry = (int(score[d]), -int(ids[d]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[at], last[at] = heap[0][0], -heap[0][1]
        found = [(rows[at], -d, s) for at, heap in enumerate(best) for s, d in heap]
        ids_out = [None if d == np.iinfo(np.int64).max else d for _, d, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array(ids_out, pa.int64()), pa.array([f[2] for f in found], pa.int64())], ["row", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item, rank, doc_id, score) of the `k` best documents of each row of `items`, of those with a score above 0.

    Items are dealt to blocks of about `BLOCK_TERMS` terms; each block is one pass over its postings, which a first pass
    over the documents writes. What a task is sent grows with its block, never with the documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    numbered = scratch.save(items.select(item_col, F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()), "items")
    terms = scratch.save(_terms(numbered, "text"), "terms")
    size = terms.agg(F.count("*").alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_TERMS))
    texts = id_and_text(docs, id_col, text_col)
    found = None
    for b in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        # terms by falling number of items, so that what many items share comes first and forms runs
        by_items = own.groupBy("term").agg(F.count("*").alias("items"))
        index = {bytes(t["term"]): at for at, t in enumerate(sorted(by_items.collect(), key=lambda t: (-t["items"], bytes(t["term"]))))}
        if not index:
            continue
        postings = scratch.save(_postings(texts, index), f"postings-{b}")
        sums = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not sums["docs"]:
            continue
        held = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect())
        df = np.array([held.get(at, 0) for at in range(len(index))], np.int64)
        weights = np.floor(1000 * np.log((2 * sums["docs"] + 2) / (2 * df + 1))).astype(np.int64)
        at = spark.createDataFrame(pa.table({"term": pa.array(list(index), pa.binary()), "at": pa.array(list(index.values()), pa.int32())}))
        sequences = own.join(at, "term").groupBy("row").agg(F.flatten(F.array_sort(F.collect_list(F.expr("array_repeat(at, int(n))")))).alias("symbols"))
        packed, rules = compress(scratch.save(sequences, f"sequences-{b}"), scratch, len(index), ROUNDS, PER_ROUND)
        wanted = [(r["row"], r["symbols"]) for r in packed.collect()]
        best = postings.mapInArrow(_best(weights, rules, wanted, sums["docs"], sums["terms"], k), "row long, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "row long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.filter("score > 0").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for by in (["row", "salt"], ["row"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return found.join(numbered.select("row", item_col), "row").select(item_col, F.col("rank").cast("int").alias("rank"), "doc_id", "score")
