"""Quality classifier by importance resampling.

Hashed word uni- and bigrams of the target texts (those labelled of high quality) and of all raw texts give two
generative models over a fixed number of buckets. A document's log importance weight is the summed log ratio of the two
over its n-grams. Documents are drawn without replacement with probability in proportion to their weights, as the top k
of log weight plus Gumbel noise; the noise is a hash of the id, so a draw can be repeated. The k-th key is found by
refining a histogram, never by sorting all rows in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, id_and_text
from .shingles import WordHashes, mixed

BUCKETS = 16_384
#: Labelled target documents that the target model uses at most: the bound of what is broadcast.
MAX_TARGET = 30_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Buckets of the lower-case words and word pairs of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = mixed(h[:-1] * _A + h[1:] * _B)
    return (np.concatenate((mixed(h), pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, total = WordHashes(), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for t in b.column("text").cast(pa.binary()).to_pylist():
            total += np.bincount(features(t, hashes), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def _counts(texts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for r in texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, max_target: int = MAX_TARGET, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket. Without target labels every ratio is 0."""
    use = labels.select(F.col("doc_id").cast("long").alias("label_id"), "quality").filter("label_id is not null and quality = 1").filter(crc_mod(F.col("label_id"), fold) != held)
    use = use.select("label_id").distinct().orderBy(F.xxhash64("label_id"), "label_id").limit(max_target)
    rows = id_and_text(docs)
    target, raw = _counts(rows.join(F.broadcast(use), rows.doc_id == use.label_id, "left_semi").select("text")), _counts(rows.select("text"))
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + smooth) / (target + smooth).sum()) - np.log((raw + smooth) / (raw + smooth).sum())


def _weigher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, hashes = shared.value, WordHashes()
        for b in batches:
            f = [features(t, hashes) for t in b.column("text").cast(pa.binary()).to_pylist()]
            w = [float(ratio[x].sum()) for x in f]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in f], pa.int64()), pa.array(w, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise as a function of an id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 2048, few: int = 4096) -> float:
    """The k-th largest value of a column, by histograms of a fixed number of bins over a shrinking range."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("z")).collect()
        counts = {r["bin"]: (r["n"], r["a"], r["z"]) for r in found}
        for b in sorted(counts, reverse=True):
            n, a, z = counts[b]
            if k <= n:
                break
            k -= n
        low, high = a, z
        if low == high:
            return low
        if n <= few:
            values = sorted((r[0] for r in rows.filter((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)
            return values[k - 1]


def resample(docs: DataFrame, ratio: np.ndarray, share: float = 0.75, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_grams, log_weight, key, kept (among the `share` of rows with largest keys).

    A null or empty text has log weight 0. Rows that repeat an id share its noise; rows of one key are kept together, as
    are rows without an id, whose noise is one value. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    rows = id_and_text(docs, id_col, text_col)
    weighed = rows.mapInArrow(_weigher(spark.sparkContext.broadcast(ratio)), "doc_id long, n_grams long, log_weight double")
    keyed = scratch.save(weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "keyed")
    k = int(keyed.count() * share)
    if not k:
        return keyed.withColumn("kept", F.lit(False))
    return keyed.withColumn("kept", F.col("key") >= kth_largest(keyed, "key", k))
