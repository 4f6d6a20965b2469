"""LM scoring: a Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

Every word of the training texts has counts of its own, as history and as predicted word; what has not been seen there
is one unknown word. Words are counted in tables partitioned by a 64-bit hash and numbered from the most frequent one
on, so that the count of a word follows from its number by a short table of steps (no more than the root of twice the
tokens). A chunk of documents asks the partitions for the numbers of its distinct words. Bigrams are pairs of numbers,
partitioned by history, so that the sums of a context, which its backoff weight needs, are made where its bigrams are
counted; only histories with more occurrences than a partition should hold spread over several by second word, and
their sums, of no more contexts than there are partitions, are added up and broadcast. Each order is the same recursion:
what has been seen has its Good-Turing discounted relative frequency, what hasn't the backoff weight of its context times
the probability one order lower. A bigram backs off to the unigram of its second word, the unigram, whose only context is
the empty one, to an even share of all words; the weights make each context sum to exactly one.

Documents are never joined with n-grams one by one: each task sends, for a chunk of documents, the sorted distinct
pairs of a partition with the documents they stand in, and gets back one partial sum for each document, since log
probabilities add up. Tables travel as packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, crc_mod, thrifty, thrifty_batches

#: Word numbers: an unknown word, the end of a text, the start of a text, then the words, frequent ones first.
UNKNOWN, END, START, FIRST = 0, 1, 2, 3
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Tokens of a chunk of documents.
CHUNK_TOKENS = 1 << 21
#: Documents of a chunk at most, so that two bytes name one.
CHUNK_DOCS = 1 << 16
#: Text bytes to a partition of the tables.
BUCKET_BYTES = 16 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_HALF = 0.5


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts of the counts 0..DISCOUNTED from the numbers of n-grams seen once, twice, ... DISCOUNTED + 1 times.

    Katz's formula; where the numbers of a small table don't give factors between 0 and 1, half a count is taken off.
    """
    k = DISCOUNTED
    plain = np.array([0.0] + [(r - 0.5) / r for r in range(1, k + 1)])
    if any(x <= 0 for x in n[: k + 1]):
        return plain
    top = (k + 1) * n[k] / n[0]
    d = np.array([0.0] + [((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top) for r in range(1, k + 1)]) if top < 1 else plain
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else plain


class Contexts:
    """Discounts and backoff weights of some contexts; bigram counts and unigram probabilities come with each call."""

    def __init__(self, discounts: np.ndarray, seen: np.ndarray, context: np.ndarray, covered: np.ndarray):
        """For each context, sums over its seen bigrams: seen, of discounted counts; context, of counts; covered, of
        the unigram probabilities of their second word."""
        self.discounts, self.context = discounts, context
        left, free = np.maximum(context - seen, 0.0), 1.0 - covered
        #: Contexts that have been followed by everything keep their counts as they are.
        self.undiscounted = (context > 0) & (free < 1e-12)
        #: Where discounts leave less than half a count for what hasn't followed, half a count is made for it.
        short = (context > 0) & ~self.undiscounted & (left < _HALF)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.scale = np.where(short, (context - _HALF) / seen, 1.0)
            left = np.where(short, _HALF, left)
            self.backoff = np.where(context > 0, np.where(self.undiscounted, 0.0, left / context / free), 1.0)

    def score(self, v: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probability after context v of words with the unigram probabilities p and these training counts after v."""
        d = np.where((counts <= DISCOUNTED) & ~self.undiscounted[v], self.discounts[np.minimum(counts, DISCOUNTED)], 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10(d * counts * self.scale[v] / self.context[v])
            unseen = np.log10(self.backoff[v]) + np.log10(p)
        return np.where(counts > 0, seen, unseen)


def unigrams(counts: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Probability of a word of each count, where types[k] words have counts[k] and unseen ones have none.

    The order without a history: one context, discounted by its own counts of counts, that backs off to an even share.
    """
    d = good_turing([int(types[counts == r].sum()) for r in range(1, DISCOUNTED + 2)])
    even = 1.0 / types.sum()
    off = np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)
    sums = ((off * counts) @ types, float(counts @ types), types[counts > 0].sum() * even)
    return 10.0 ** Contexts(d, *(np.array([x]) for x in sums)).score(np.zeros(len(counts), np.int64), np.full(len(counts), even), counts)


class Katz(Contexts):
    """A whole model in arrays by word number."""

    def __init__(self, counts: np.ndarray, discounts: np.ndarray, seen: np.ndarray, context: np.ndarray, covered: np.ndarray):
        use = np.arange(len(counts)) != START  # a start is never predicted
        self.p = np.where(use, unigrams(counts, use.astype(np.int64)), 0.0)
        super().__init__(discounts, seen, context, covered)

    def log10(self, v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probability of word w after word v, given the training count of the pair."""
        return self.score(v, self.p[w], counts)


class Steps:
    """Counts and unigram probabilities by word number: numbers go up as counts go down, so few steps tell all counts."""

    def __init__(self, counts: list[int], words: list[int], n_end: int):
        """counts: the different counts of words, falling; words: how many words have each."""
        self.n_types, self.n_end = sum(words), n_end
        self.n_train = sum(c * n for c, n in zip(counts, words, strict=True)) + n_end
        self.starts = np.concatenate(([UNKNOWN, END, START], FIRST + np.cumsum([0, *words])[:-1])).astype(np.int64)
        self.counts = np.array([0, n_end, n_end, *counts], np.int64)
        self.unigrams = unigrams(self.counts, np.array([1, 1, 0, *words], np.int64))
        if FIRST + self.n_types > 1 << 32:
            raise ValueError("more than 2**32 different words")

    def _step(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, numbers, "right") - 1

    def count(self, numbers: np.ndarray) -> np.ndarray:
        return self.counts[self._step(numbers)]

    def p(self, numbers: np.ndarray) -> np.ndarray:
        """Probability of words without a history; a start is never predicted."""
        return self.unigrams[self._step(numbers)]

    def parts(self, v: np.ndarray, n_buckets: int) -> np.ndarray:
        """Partitions over which the bigrams of a history spread: one unless it takes more than two partitions' share."""
        return np.maximum(1, -(-self.count(v) // max(1, 2 * self.n_train // n_buckets)))

    def bucket(self, pairs: np.ndarray, n_buckets: int) -> np.ndarray:
        v, w = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        spread = lambda x: (x + np.uint64(1)) * _SPREAD >> np.uint64(32)
        return ((spread(v) + spread(w) % self.parts(v, n_buckets).astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(flat, codec="zstd", asbytes=True) if flat else b"")


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n).T).view(kind).ravel()


_SHAPE = "kind int, chunk long, bucket long, n long, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in _SHAPE.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 5]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*(r + (None,) * (len(_NAMES) - len(r)) for r in rows), strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _arrow(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for k in range(table.num_rows):
        yield {c: table.column(c)[k].as_py() for c in table.schema.names}


def _ranges(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(0, np.int64)
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        yield int(of[a]), slice(int(a), int(z))


class _Seen(dict):
    """Words of a chunk, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(n_buckets: int):
    """Rows of a chunk of documents: kind 0 its documents and tokens, kind 1 its distinct words of one bucket."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, n, of = TaskContext.get().partitionId() << 24, 0, 0, _Seen()
        docs: list[tuple[int | None, bool, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            chunk = task | k
            sizes = np.array([len(x) for _, _, x in docs], np.int64)
            keys, rank = np.unique(np.fromiter(map(xxh3_64_intdigest, of), np.uint64, len(of)), return_inverse=True)
            tokens = rank.astype(np.uint32)[np.concatenate([x for _, _, x in docs])]
            held = np.array([h for _, h, _ in docs], bool)
            counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(keys)).astype(np.uint32)
            ids = np.array([0 if i is None else i for i, _, _ in docs], np.int64)
            flags = np.array([(i is None) + 2 * h for i, h, _ in docs], np.int64)
            rows = [(0, chunk, -1, int((~held).sum()), np.concatenate((ids, flags, sizes)).tobytes(), _pack(tokens))]
            bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            rows += [(1, chunk, b, 0, _pack(keys[s]), _pack(counts[s])) for b, s in _ranges(bucket)]
            return _batch(rows)

        for batch in batches:
            for doc_id, text, held_out in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                words = text.lower().split()
                docs.append((doc_id, held_out, np.fromiter(map(of.__getitem__, words), np.uint32, len(words))))
                n += len(words) + 1
                if n > CHUNK_TOKENS or len(docs) == CHUNK_DOCS:
                    yield emit()
                    docs, n, k = [], 0, k + 1
                    of.clear()
        if docs:
            yield emit()

    return run


def _merge_words(group: pa.Table) -> pa.Table:
    """Training counts of the words of a bucket; those without any are left out."""
    keys = np.concatenate([_unpack(x, np.uint64) for x in group.column("a").to_pylist()])
    counts = np.concatenate([_unpack(x, np.uint32) for x in group.column("b").to_pylist()])
    keys, at = np.unique(keys[counts > 0], return_inverse=True)
    total = np.bincount(at, weights=counts[counts > 0], minlength=len(keys)).astype(np.int64)
    return _arrow([(0, 0, group.column("bucket")[0].as_py(), len(keys), _pack(keys), _pack(total))])


def _count_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in _rows(batch):
            counts, words = np.unique(_unpack(r["b"], np.int64), return_counts=True)
            bucket = np.full(len(counts), r["bucket"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(counts), pa.array(words.astype(np.int64))], ["bucket", "count", "words"])


def _numbers(shared):
    """Answers the chunks' questions for the numbers of words."""

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        steps: Steps = shared.value
        known, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for r in _rows(words):
            known, counts = _unpack(r["a"], np.uint64), _unpack(r["b"], np.int64)
            before = {x["count"]: x["before"] for x in r["offsets"]}
            start = dict(zip(steps.counts[FIRST:].tolist(), steps.starts[FIRST:].tolist(), strict=True))
            order = np.argsort(counts, kind="stable")
            numbers = np.zeros(len(known), np.int64)
            for c, s in _ranges(counts[order]):
                numbers[order[s]] = start[c] + before[c] + np.arange(s.stop - s.start)
        out = []
        for r in _rows(asked):
            keys = _unpack(r["a"], np.uint64)
            got = np.full(len(keys), UNKNOWN, np.uint32)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                got = np.where(known[at] == keys, numbers[at], UNKNOWN).astype(np.uint32)
            out.append((1, r["chunk"], r["bucket"], 0, _pack(got)))
        return _arrow(out)

    return run


def _pairs(shared, n_buckets: int):
    """Rows of a chunk of documents: kind 0 its documents, kind 2 its distinct bigrams of one bucket."""

    def run(heads: pa.Table, answers: pa.Table) -> pa.Table:
        steps: Steps = shared.value
        head = next(_rows(heads))
        chunk = head["chunk"]
        ids, flags, sizes = np.frombuffer(head["a"], np.int64).reshape(3, -1)
        parts = sorted((r["bucket"], r["a"]) for r in _rows(answers))
        numbers = np.concatenate([np.zeros(0, np.uint32), *(_unpack(a, np.uint32) for _, a in parts)])
        n_docs = len(sizes)
        of_word = np.repeat(np.arange(n_docs), sizes)
        words = numbers[_unpack(head["b"], np.uint32)] if len(numbers) else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(n_docs, dtype=np.uint16), sizes + 1)
        v, w = np.full(len(doc), START, np.uint64), np.full(len(doc), END, np.uint64)
        at = np.arange(len(words)) + of_word
        w[at] = words
        v[at + 1] = words
        count = steps.count(w)
        known = np.bincount(doc, weights=count > 0, minlength=n_docs)
        base = np.bincount(doc, weights=np.log10((count + 1) / (steps.n_train + steps.n_types + (steps.n_end > 0) + 1)), minlength=n_docs)
        # contexts never seen back off with weight one
        new = steps.count(v) == 0
        score = np.bincount(doc, weights=np.where(new, np.log10(steps.p(w)), 0.0), minlength=n_docs)
        rows = [(0, chunk, -1 - chunk, 0, np.concatenate((ids, flags, sizes + 1)).tobytes(), known.tobytes(), base.tobytes(), score.tobytes())]
        pair, doc = (v << np.uint64(32) | w)[~new], doc[~new]
        order = np.argsort(pair, kind="stable")
        pair, doc = pair[order], doc[order]
        if len(pair):
            first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))))
            times = np.diff(first, append=len(pair)).astype(np.uint32)
            pair, doc = pair[first], doc[first]
            bucket = steps.bucket(pair, n_buckets)
            order = np.argsort(bucket, kind="stable")
            pair, doc, times = pair[order], doc[order], times[order]
            trained = np.where(flags[doc] & 2, 0, times).astype(np.int64)
            for b, s in _ranges(bucket[order]):
                own = pair[s]
                at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                n_train = np.add.reduceat(trained[s], at).astype(np.uint32)
                rows.append((2, chunk, b, 0, _pack(own[at]), _pack(n_train), _pack(np.diff(at, append=len(own)).astype(np.uint32)), _pack(doc[s]), _pack(times[s])))
        return _arrow(rows)

    return run


_MERGED = "kind int, chunk long, a binary, b binary, c binary, d binary, e binary, times binary, parts binary, n_of array<long>, hot array<struct<v:long,n_of:array<double>,covered:double>>"
_SUMS = pa.list_(pa.struct([("v", pa.int64()), ("n_of", pa.list_(pa.float64())), ("covered", pa.float64())]))


def _context_sums(steps: Steps, v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted pairs: the distinct first words and, for each, how many pairs have each discounted count, and the
    unigram probabilities of the words that have followed."""
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    n_of = np.stack([np.add.reduceat((counts == r).astype(float), first) for r in range(1, DISCOUNTED + 1)], axis=1)
    return first, n_of, np.add.reduceat(np.where(counts > 0, steps.p(w), 0.0), first)


def _merge_pairs(shared, n_buckets: int):
    """One row for a bucket: its pairs with their training counts, and which documents they stand in."""
    names = [x.split(" ")[0] for x in _MERGED.split(", ")]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 7, pa.list_(pa.int64()), _SUMS]

    def run(group: pa.Table) -> pa.Table:
        steps: Steps = shared.value
        if group.column("kind")[0].as_py() == 0:
            rows = [(0, r["chunk"], r["a"], r["b"], r["c"], r["d"], None, None, None, [0] * (DISCOUNTED + 1), []) for r in _rows(group)]
        else:
            column = lambda c, kind: [_unpack(x, kind) for x in group.column(c).to_pylist()]
            keys = column("a", np.uint64)
            docs = column("d", np.uint16)
            pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate(column("b", np.uint32)), minlength=len(pairs)).astype(np.int64)
            v, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first, n_of, covered = _context_sums(steps, v, w, counts)
            hot = np.flatnonzero(steps.parts(v[first], n_buckets) > 1)
            sums = [{"v": int(v[first[k]]), "n_of": n_of[k].tolist(), "covered": float(covered[k])} for k in hot]
            parts = np.stack([np.array(x, np.int64) for x in (group.column("chunk").to_pylist(), [len(x) for x in keys], [len(x) for x in docs])])
            spread = [np.diff(x, prepend=0).astype(np.uint32) for x in np.split(at, np.cumsum(parts[1])[:-1])]
            packed = (pairs, counts, np.concatenate(spread), np.concatenate(column("c", np.uint32)), np.concatenate(docs), np.concatenate(column("e", np.uint32)))
            rows = [(2, -1, *map(_pack, packed), parts.tobytes(), [int((counts == r).sum()) for r in range(1, DISCOUNTED + 2)], sums)]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, discounts, hot = shared.value
        for batch in batches:
            for r in _rows(batch):
                pairs, counts = _unpack(r["a"], np.uint64), _unpack(r["b"], np.int64)
                v, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
                first, n_of, covered = _context_sums(steps, v, w, counts)
                for k in np.flatnonzero(np.isin(v[first], list(hot))):
                    n_of[k], covered[k] = hot[int(v[first[k]])]
                context = steps.count(v[first]).astype(float)
                seen = context - n_of @ ((1.0 - discounts[1:]) * np.arange(1, DISCOUNTED + 1))
                of = np.repeat(np.arange(len(first)), np.diff(first, append=len(v)))
                log10 = Contexts(discounts, seen, context, covered).score(of, steps.p(w), counts)
                at, n_docs, doc, times = _unpack(r["c"], np.uint32), _unpack(r["d"], np.uint32), _unpack(r["e"], np.uint16), _unpack(r["times"], np.uint32)
                a = z = 0
                rows = []
                for chunk, n, m in np.frombuffer(r["parts"], np.int64).reshape(3, -1).T.tolist():
                    each = np.repeat(log10[np.cumsum(at[a : a + n], dtype=np.int64)], n_docs[a : a + n]) * times[z : z + m]
                    here, own = np.unique(doc[z : z + m], return_inverse=True)
                    rows.append((2, chunk, 0, 0, _pack(here), np.bincount(own, weights=each).tobytes()))
                    a, z = a + n, z + m
                yield _batch(rows)

    return run


def _assemble(n_train: int):
    def run(heads: pa.Table, partial: pa.Table) -> pa.Table:
        head = next(_rows(heads))
        ids, flags, sizes = np.frombuffer(head["a"], np.int64).reshape(3, -1)
        known, base, score = (np.frombuffer(head[c], np.float64).copy() for c in "bcd")
        for r in _rows(partial):
            score[_unpack(r["a"], np.uint16)] += np.frombuffer(r["b"], np.float64)
        arrays = [
            pa.array(ids, pa.int64(), mask=(flags & 1).astype(bool)), pa.array((flags & 2) > 0), pa.array(sizes), pa.array(np.rint(known).astype(np.int64)),
            pa.array(np.full(len(ids), n_train, np.int64)), pa.array(base), pa.array(score),
        ]
        return pa.Table.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, fold: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id) modulo `fold` is not `held`; a row without an id is learnt from. A null text is
    empty: its only token is the end. Rows that repeat an id are rows like any others. An empty table, and one without
    training rows, give defined results: no rows, or scores from a model that has seen nothing. A very long text is one
    chunk of its own, which a task must hold.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(crc_mod(key, fold) == held, F.lit(False)).alias("held_out"))
    n_buckets = max(8, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    chunks = scratch.save(rows.mapInArrow(thrifty_batches(_chunks(n_buckets)), _SHAPE), "chunks")
    asked = chunks.filter("kind = 1")
    words = scratch.save(asked.groupBy("bucket").applyInArrow(thrifty(_merge_words), _SHAPE), "words").select("bucket", "a", "b")
    counts = words.mapInArrow(_count_counts, "bucket long, count long, words long")
    histogram = counts.groupBy("count").agg(F.sum("words").alias("words")).orderBy(F.desc("count")).collect()
    n_end = chunks.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    steps = Steps([r["count"] for r in histogram], [r["words"] for r in histogram], n_end)
    shared = spark.sparkContext.broadcast(steps)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("count").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("bucket", "count", before.alias("before")).groupBy("bucket").agg(F.collect_list(F.struct("count", "before")).alias("offsets"))
    numbered = words.join(offsets, "bucket")
    answers = asked.select("chunk", "bucket", "a").groupBy("bucket").cogroup(numbered.groupBy("bucket")).applyInArrow(thrifty(_numbers(shared)), _SHAPE)
    heads = chunks.filter("kind = 0").select("chunk", "a", "b")
    found = heads.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "a").groupBy("chunk")).applyInArrow(thrifty(_pairs(shared, n_buckets)), _SHAPE)
    merged = scratch.save(found.groupBy("bucket").applyInArrow(thrifty(_merge_pairs(shared, n_buckets)), _MERGED), "merged")
    scratch.drop("chunks", "words")

    sums = merged.agg(*(F.sum(F.get("n_of", F.lit(r))).alias(f"n{r}") for r in range(DISCOUNTED + 1))).first()
    discounts = good_turing([x or 0 for x in sums])
    by_context = merged.select(F.explode("hot").alias("h")).groupBy("h.v").agg(*(F.sum(F.get("h.n_of", F.lit(r))).alias(f"n{r}") for r in range(DISCOUNTED)), F.sum("h.covered").alias("covered")).collect()
    hot = {r["v"]: ([r[f"n{k}"] for k in range(DISCOUNTED)], r["covered"]) for r in by_context}
    model = spark.sparkContext.broadcast((steps, discounts, hot))
    partials = merged.filter("kind = 2").select("a", "b", "c", "d", "e", "times", "parts").mapInArrow(thrifty_batches(_score(model)), _SHAPE).select("chunk", "a", "b")
    ends = merged.filter("kind = 0").select("chunk", "a", "b", "c", "d")
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ends.groupBy("chunk").cogroup(partials.groupBy("chunk")).applyInArrow(thrifty(_assemble(steps.n_train)), shape)
