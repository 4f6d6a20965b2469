"""Near-duplicate detection: many universal hash minima with banding, signature verification and connected components.

Each text is the set of its distinct 5-word shingles. `BANDS * ROWS` strongly universal hashes give its minima; texts
that agree on one band meet in a bucket. Equal sets collapse to one representative first. In every bucket, each member
is paired with the bucket's smallest id; pairs pass the signature test, then a comparison of the full sets, and the
links' components are found by alternating large-star and small-star.

Buckets whose members then still belong to several components are compared once more, in blocks of bounded size: the
members of a bucket's largest component need no comparison with one another, so they meet only the blocks of all
others. A block keeps the components it has joined and tests no pair within one, so it gives a link for each join and
never all of its pairs. Sets of at most SKETCH shingles are compared whole there; pairs with a larger set that neither
signature nor bottom-k sketch part are confirmed on the full sets afterwards. These links join components, whose own
components are composed with the first ones. No link between members of different components is skipped.

A pair at the least similarity of 0.75 shares no band with probability 5e-6, fails the signature test with 1e-6 and, if
one of its sets is larger than SKETCH, the sketch test with 3e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, text_slices
from .components import components
from .shingles import WordHashes, mixed, shingle_set

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of the one-byte minima of two texts, so many agree at least: 4.9 standard deviations below the mean at 0.75.
LEAST_EQUAL = 72
#: Members of a bucket that one block holds when members are compared with one another.
BLOCK = 1024
#: Shingle hashes of a bottom-k sketch: a smaller set is whole in it.
SKETCH = 512
#: Parts of a bucket, or of the pairs of one document, that are dealt out apart.
SALTS = 64

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, MINIMA) minima of multiply-add-shift hashes, for non-empty sets."""
    cat = np.concatenate(sets) >> np.uint64(32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out, buffer = np.empty((len(sets), MINIMA), np.uint32), np.empty_like(cat)
    for j in range(MINIMA):
        np.multiply(cat, _A[j], out=buffer)
        np.add(buffer, _B[j], out=buffer)
        np.right_shift(buffer, np.uint64(32), out=buffer)
        out[:, j] = np.minimum.reduceat(buffer, starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys that differ between bands."""
    x = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    return mixed((x * _BAND[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, known = WordHashes(), {}
    for b in batches:
        for at, texts in text_slices(b):
            n, keys = [], []
            fresh: dict[bytes, np.ndarray] = {}
            held = 0
            if len(known) > 20_000:
                known.clear()
            for t in texts:
                s = shingle_set(t, hashes)
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    continue
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                keys.append(key)
                if key not in known and key not in fresh:
                    fresh[key] = s
                    held += len(s)
                    if held > 60_000:  # a chunk that stays in cache
                        known.update(_signatures(fresh))
                        fresh, held = {}, 0
            if fresh:
                known.update(_signatures(fresh))
            of = [known.get(k) if k else None for k in keys]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([x and x[0] for x in of], pa.binary()), pa.array([x and x[1] for x in of], pa.binary())],
                ["doc_id", "n_shingles", "key", "bands", "signature"],
            )


def _signatures(sets: dict[bytes, np.ndarray]) -> dict[bytes, tuple[bytes, bytes]]:
    m = minima([*sets.values()])
    keys, small = band_keys(m), m.astype(np.uint8)
    return {k: (keys[i].tobytes(), small[i].tobytes()) for i, k in enumerate(sets)}


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), BANDS)
        keys = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["bucket", "rep"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("sx", "sy"))
        near = pa.array((x == y).sum(axis=1) >= LEAST_EQUAL)
        yield pa.RecordBatch.from_arrays([b.column("x").filter(near), b.column("y").filter(near)], ["x", "y"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of each text's set and its least shingle hashes, SKETCH at most."""
    hashes = WordHashes()
    for b in batches:
        for at, texts in text_slices(b):
            sets = [shingle_set(t, hashes) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())], ["rep", "n", "sketch"]
            )


def _parted(a: np.ndarray, b: np.ndarray, whole_a: bool, whole_b: bool) -> bool:
    """Whether sketches of two sets, one at least not whole, say that the sets are less similar than a link."""
    reach = min(s[-1] for s, whole in ((a, whole_a), (b, whole_b)) if not whole)
    a, b = (s[: np.searchsorted(s, reach, "right")] for s in (a, b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    union, share = len(a) + len(b) - both, PERCENT / 100
    return both < share * union - 1 - 5 * np.sqrt(share * (1 - share) * union)


def _compare(low: int, high: int, rows: list) -> list[tuple]:
    """Of the members of one or two blocks: (component, component, null, null) for each join of two components by a link
    between sets that are whole here, and (component, component, x, y) for pairs that need their full sets."""
    rep, label, block = (np.array([r[k] for r in rows]) for k in range(3))
    sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, MINIMA)
    if (label == label[0]).all():
        return []
    component = label.copy()
    size = [r[4] for r in rows]
    each = [np.frombuffer(r[5], np.uint64) for r in rows]
    shingles, flat = np.unique(np.concatenate(each), return_inverse=True)
    edge = np.concatenate(([0], np.cumsum([len(s) for s in each])))
    flag = np.zeros(len(shingles), bool)
    out: list[tuple] = []
    first = np.flatnonzero(block == low)
    second = first if low == high else np.flatnonzero(block == high)
    for at, i in enumerate(first):
        other = second[at + 1 :] if low == high else second
        other = other[label[other] != label[i]]
        if not len(other):
            continue
        equal = (sig[other] == sig[i]).sum(axis=1)
        near = other[np.argsort(-equal, kind="stable")][: int((equal >= LEAST_EQUAL).sum())]
        own = flat[edge[i] : edge[i + 1]]
        flag[own] = True
        for j in near:
            if label[j] == label[i] or rep[i] == rep[j]:
                continue
            whole = size[i] <= SKETCH, size[j] <= SKETCH
            if all(whole):
                both = int(flag[flat[edge[j] : edge[j + 1]]].sum())
                if 100 * both >= PERCENT * (size[i] + size[j] - both):
                    out.append((int(component[i]), int(component[j]), None, None))
                    label[label == label[j]] = label[i]
            elif not _parted(each[i], each[j], *whole):
                out.append((int(component[i]), int(component[j]), int(max(rep[i], rep[j])), int(min(rep[i], rep[j]))))
        flag[own] = False
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The comparisons of rows sorted by (bucket, low, high)."""
    group, rows = None, []
    columns = ("rep", "component", "block", "signature", "n", "sketch")

    def out() -> pa.RecordBatch:
        found = _compare(group[1], group[2], rows)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], ["a", "b", "x", "y"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high")), strict=True)
        for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if key != group:
                if rows:
                    yield out()
                group, rows = key, []
            rows.append(row)
    if rows:
        yield out()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (y, salt, x), where rows with a null x have y's texts: (a, b) of pairs whose full sets are similar
    enough. An id with several texts is linked by any of them."""
    hashes, at, own = WordHashes(), None, []
    for batch in batches:
        for first, texts in text_slices(batch):
            part = batch.slice(first, len(texts))
            found: list[tuple[int, int]] = []
            for y, salt, x, a, b, text in zip(*(part.column(c).to_pylist() for c in ("y", "salt", "x", "a", "b")), texts, strict=True):
                s = shingle_set(text, hashes)
                if x is None:
                    own = [*own, s] if at == (y, salt) else [s]
                    at = (y, salt)
                elif at == (y, salt):
                    for z in own:
                        both = len(np.intersect1d(z, s, assume_unique=True))
                        if 100 * both >= PERCENT * (len(z) + len(s) - both):
                            found.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs (x, y, a, b) whose full sets are similar enough. A hot y is salted: its text goes to each of its
    salts once."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)))
    none = F.lit(None).cast("long")
    heads = salted.select("y", "salt").distinct().select(F.col("y").alias("owner"), "y", "salt", none.alias("x"), none.alias("a"), none.alias("b"))
    wanted = salted.select(F.col("x").alias("owner"), "y", "salt", "x", "a", "b").union(heads)
    dealt = wanted.join(texts.hint("merge"), F.col("owner") == texts.doc_id).select("y", "salt", "x", "a", "b", "text")
    return dealt.repartition("y", "salt").sortWithinPartitions("y", "salt", F.col("x").asc_nulls_first()).mapInArrow(_confirm, "a long, b long")


def _leftover(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, rep, component, block, low, high): the members of buckets of several components, once for each block they
    have to meet. A bucket's largest component has the first blocks, which don't meet one another."""
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS))
    labelled = buckets.filter("size > 2").join(found, buckets.rep == found.id, "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"), salt.alias("salt"))
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = several.select("bucket", F.col("top.component").alias("main"), blocks(F.col("top.n")).alias("m"), blocks(F.col("members") - F.col("top.n")).alias("r"))
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    inside = F.col("component") == F.col("main")
    own = F.xxhash64("rep", F.lit(1))
    member = labelled.join(plan, ["bucket", "salt"]).withColumn("block", F.when(inside, F.pmod(own, F.col("m"))).otherwise(F.col("m") + F.pmod(own, F.col("r"))).cast("int"))
    met = member.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("m")).otherwise(0), F.col("m") + F.col("r") - 1)))
    return met.select("bucket", "rep", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are split at white space and lower-cased in A-Z only; a text of under five words is one shingle. A text
    without words, or a null one, has no shingles, links with nothing and is kept. component_id is the smallest id
    reachable by links of similarity 0.75 or more; kept says that it is the row's own. Rows of one id are one document:
    its texts are linked to one another and to whatever any of them is similar to. Rows without an id get a null
    component and aren't kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = id_and_text(docs, id_col, text_col)
    signed = scratch.save(rows.mapInArrow(_signed, "doc_id long, n_shingles long, key binary, bands binary, signature binary"), "signed")
    named = signed.filter("key is not null and doc_id is not null")
    least_of = named.groupBy("key").agg(F.min(F.struct("doc_id", "bands", "signature")).alias("r"))
    classes = scratch.save(least_of.select("key", F.col("r.doc_id").alias("rep"), "r.bands", "r.signature"), "classes")
    signatures = classes.select("rep", "signature")
    bands = classes.select("rep", "bands").mapInArrow(_band_rows, "bucket long, rep long")
    least = bands.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("size")).filter("least < most").drop("most")
    buckets = scratch.save(bands.join(least, "bucket"), "buckets")
    members = buckets.select("rep").distinct().withColumnRenamed("rep", "__rep")
    texts = rows.join(members.hint("merge"), F.col("doc_id") == F.col("__rep")).withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    texts = scratch.save(texts.select("doc_id", "text"), "texts")

    stars = buckets.filter("rep <> least").select(F.col("rep").alias("x"), F.col("least").alias("y")).distinct()
    sx, sy = (signatures.select(F.col("rep").alias(n), F.col("signature").alias(f"s{n}")) for n in "xy")
    alike = stars.join(sx, "x").join(sy, "y").select("x", "y", "sx", "sy").mapInArrow(_alike, "x long, y long")
    first = scratch.save(alike.select("x", "y", F.col("x").alias("a"), F.col("y").alias("b")), "first")
    links = _confirmed(first, texts)
    key = F.xxhash64("key")
    several = scratch.save(named.groupBy("doc_id").agg(F.min(key).alias("k1"), F.max(key).alias("k2")).filter("k1 <> k2").select("doc_id"), "several")
    if not several.isEmpty():
        links = links.union(named.join(several, "doc_id").join(classes.select("key", "rep"), "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = scratch.save(components(links, scratch, "stars-first"), "found-first")

    dealt = scratch.save(_leftover(buckets, found), "dealt")
    joins = None
    if not dealt.isEmpty():
        needed = dealt.select(F.col("rep").alias("doc_id")).distinct()
        sketches = texts.join(needed.hint("merge"), "doc_id").mapInArrow(_sketched, "rep long, n long, sketch binary")
        known = scratch.save(signatures.join(sketches.hint("merge"), "rep"), "known")
        blocks = dealt.join(known.hint("merge"), "rep").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        close = scratch.save(blocks.mapInArrow(_blocks, "a long, b long, x long, y long"), "close")
        open_pairs = scratch.save(close.filter("x is not null").dropDuplicates(["x", "y"]).join(first.select("x", "y"), ["x", "y"], "left_anti").select("x", "y", "a", "b"), "open")
        joins = close.filter("x is null").select("a", "b")
        if not open_pairs.isEmpty():
            joins = joins.union(_confirmed(open_pairs, texts))
        joins = scratch.save(components(joins, scratch, "stars-last"), "found-last")
    scratch.drop("buckets", "texts", "first", "several", "dealt", "known", "close", "open")

    of = classes.select(F.col("key").alias("class_key"), "rep").join(found, F.col("rep") == found.id, "left").select("class_key", F.coalesce("component", "rep").alias("component"))
    if joins is not None:
        last = joins.select(F.col("id").alias("last_id"), F.col("component").alias("last"))
        of = of.join(last, F.col("component") == last.last_id, "left").select("class_key", F.coalesce("last", "component").alias("component"))
    narrow = signed.select("doc_id", "n_shingles", "key")
    out = narrow.join(of, F.col("key") == F.col("class_key"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` with one document of each group of near copies, the one of the smallest id; every column stays.

    Rows of one id are one document and stay or go together; rows without an id all stay, as do empty and null texts.
    """
    gone = near_duplicates(docs, id_col=id_col, **options).filter("doc_id is not null and not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone.gone, "left_anti")
