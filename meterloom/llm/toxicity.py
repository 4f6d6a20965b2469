"""Toxicity by maximum-scoring segment search.

Token weights are log-odds between toxic and other labelled texts under an informative Dirichlet prior, kept where
their z-score is high. A token is a lower-case word, or its first seven, five or four characters when the word itself has no
weight, so that inflected forms count. A linear-time scan splits a document into its maximal scoring segments; the best
segment and all significant ones are judged by extreme-value statistics (Karlin-Altschul), and a logistic fit maps that
evidence to a probability. Both parameters of the extreme-value law come from the clean training texts: lambda from how
often each weight occurs there, K from the upper half of their best segments, by maximum likelihood. The model is no larger than the
bounded training sample, whatever the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, text_slices

#: Labelled rows that a fit uses at most, drawn by a hash of their id: the bound of what is broadcast.
MAX_TRAIN = 30_000
#: Distinct tokens that a task counts before it hands on what it has.
HELD_TOKENS = 150_000
#: Weights are multiples of 1 / GRID, so that their histogram is small.
GRID = 16
PREFIXES = (7, 5, 4)
_STRIP = b".,;:!?*$&%#|\"'()[]{}<>-_=+/\\~`@^"


@dataclass
class ToxicModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    miss: float = -0.1
    rate: float = 0.7  # lambda of the extreme-value law
    scale: float = 0.1  # K of the extreme-value law, fitted
    bias: float = -3.0
    slope: float = 0.5


class Hits(dict):
    """Weight of each word seen by a task, 0 for those without one."""

    limit = 300_000

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = next((self.weights[t] for t in forms(word) if t in self.weights), 0.0)
        return value


def forms(word: bytes) -> list[bytes]:
    """The tokens of a word, most specific first: itself, then prefixes marked by their length."""
    core = word.strip(_STRIP)
    text = core.decode("utf-8", "ignore")
    return [b"w" + core, *(b"%d" % n + text[:n].encode() for n in PREFIXES if len(text) >= n)]


def segments(positions: list[int], scores: list[float], miss: float) -> list[tuple[int, int, float]]:
    """Maximal scoring segments (start, end, score), in one pass over the scored tokens; each token between costs `miss`.

    Each new candidate joins the last earlier one that starts lower and ends lower (Ruzzo and Tompa's rule).
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for at, score in zip(positions, scores, strict=True):
        total += miss * (at - last - 1)
        start, before = at, total
        total += score
        last = at
        end, after = at + 1, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= after:
                found.append((start, end, before, after))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, after - before) for s, e, before, after in found]


def evidence(n_words: int, found: list[float], model: ToxicModel) -> tuple[float, int]:
    """Summed normalised scores of the significant segments (at least the best one's), and how many are significant."""
    if not found:
        return -20.0, 0
    bits = sorted((model.rate * s - math.log(max(model.scale * n_words, 1e-9)) for s in found), reverse=True)
    strong = [b for b in bits if b > 3.0]
    return max(-20.0, min(60.0, bits[0] + sum(strong[1:]))), len(strong)


def located(words: list[bytes], hits: Hits, model: ToxicModel) -> tuple[list[int], list[float], list[tuple[int, int, float]]]:
    """Places and weights of the words that have one, and the segments over them."""
    weights = list(map(hits.__getitem__, words))
    at = [k for k, w in enumerate(weights) if w]
    own = [weights[k] for k in at]
    return at, own, segments(at, own, model.miss) if at else []


def scored(words: list[bytes], hits: Hits, model: ToxicModel) -> tuple[float, list[tuple[int, int, float]], int]:
    found = located(words, hits, model)[2]
    x, n = evidence(len(words), [s for _, _, s in found], model)
    return x, found, n


def probability(x: float, model: ToxicModel) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + model.slope * x))))


def _words(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[list[bytes]]:
    """The words of one text at a time."""
    for _, texts in text_slices(batch, text_col):
        for t in texts:
            yield t.lower().split()


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for each token and label: occurrences and texts. The empty token has the numbers of words and of texts."""
    held: dict[tuple[bytes, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        n, texts = zip(*held.values(), strict=True) if held else ((), ())
        columns = [pa.array([t for t, _ in held], pa.binary()), pa.array([y for _, y in held], pa.int32()), pa.array(n, pa.int64()), pa.array(texts, pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["token", "toxic", "n", "texts"])

    for b in batches:
        for words, toxic in zip(_words(b), b.column("toxic").to_pylist(), strict=True):
            own: Counter = Counter()
            for w, n in Counter(words).items():
                for t in forms(w):
                    own[t] += n
            own[b""] = len(words)
            for t, n in own.items():
                sums = held.setdefault((t, toxic), [0, 0])
                sums[0] += n
                sums[1] += 1
            if len(held) > HELD_TOKENS:
                yield out()
    yield out()


def train_rows(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold, equal texts once."""
    key = F.col("doc_id").cast("long")
    use = labels.select(key.alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("label_id is not null and toxic in (0, 1)").filter(crc_mod(F.col("label_id"), fold) != held)
    use = use.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(max_train)
    texts = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(use), texts.doc_id == use.label_id).groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, prior: float = 0.05, z_least: float = 4.0, odds_least: float = 2.0, texts_least: int = 4, **rows) -> ToxicModel:
    """Learns weights and calibration. Tables without labels of both kinds give a model that calls nothing toxic.

    The Dirichlet prior of a token is `prior` times its occurrences in all training texts. A weight is kept with a
    z-score of `z_least`, log-odds of `odds_least` and toxic texts of `texts_least` at least.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    train = scratch.save(train_rows(docs, labels, **rows), "train")
    of = lambda c, y: F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0))
    counts = train.mapInArrow(_count_tokens, "token binary, toxic int, n long, texts long").groupBy("token")
    pairs = scratch.save(counts.agg(of("n", 1).alias("y"), of("n", 0).alias("o"), of("texts", 1).alias("y_texts")), "tokens")
    words = pairs.filter(F.length("token") == 0).first()
    model = ToxicModel()
    if words is None or not words["y"] or not words["o"]:
        return model
    n_y, n_o = words["y"], words["o"]
    alpha = prior * (F.col("y") + F.col("o"))
    odds = lambda k, n: F.log((F.col(k) + alpha) / F.greatest(n + prior * (n_y + n_o) - F.col(k) - alpha, F.lit(0.5)))
    delta = odds("y", n_y) - odds("o", n_o)
    z = delta / F.sqrt(1 / (F.col("y") + alpha) + 1 / (F.col("o") + alpha))
    best = (
        pairs.filter((F.length("token") > 0) & (F.col("y_texts") >= texts_least))
        .select("token", delta.alias("delta"), z.alias("z"))
        .filter((F.col("z") >= z_least) & (F.col("delta") >= odds_least))
        .collect()  # of the bounded sample, tokens of several toxic texts
    )
    if not best:
        return model
    model.weights = {bytes(r["token"]): max(1, round(GRID * min(6.0, r["delta"]))) / GRID for r in best}
    found = scratch.save(train.mapInArrow(_segments_of(spark.sparkContext.broadcast(model)), "toxic int, n_words long, hits array<double>, found array<double>"), "segments")
    clean = found.filter("toxic = 0")
    times = {r["w"]: r["n"] for r in clean.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    model.rate = _decay(times, n_o, model)
    best_of = clean.select("n_words", F.coalesce(F.array_max("found"), F.lit(0.0)).alias("s"))
    # maximum likelihood of K over the upper half of the clean texts' best segments; all other texts lie below, by an unknown amount
    usual = best_of.filter("s > 0").agg(F.percentile("s", F.lit(0.5))).first()[0] or min(model.weights.values())
    law = best_of.agg(F.count(F.when(F.col("s") >= usual, 1)).alias("n"), F.sum(F.col("n_words") * F.exp(-model.rate * F.greatest("s", F.lit(usual)))).alias("e")).first()
    model.scale = max(law["n"], 0.5) / max(law["e"], 1e-9)
    bins = found.mapInArrow(_evidence_of(spark.sparkContext.broadcast(model)), "x double, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()
    model.bias, model.slope = _logistic([(r["x"], r["toxic"], r["n"]) for r in bins])
    scratch.drop("train", "tokens", "segments")
    return model


def _decay(times: dict[float, int], n_words: int, model: ToxicModel) -> float:
    """Lambda: the positive root of E[exp(lambda * score)] = 1 over the words of clean texts.

    Where no weight occurs in them, the least one counts as seen half a time; where the mean score isn't below 0, hits
    count less often, so that it is.
    """
    seen = times or {min(model.weights.values()): 0.5}
    scores, p = np.array([*seen]), np.array([*seen.values()], float) / max(1, n_words)
    p *= min(1.0, 0.5 * -model.miss / float(p @ (scores - model.miss)))
    low, up = 1e-6, 50.0
    for _ in range(80):
        mid = (low + up) / 2
        total = float(p @ np.exp(np.minimum(mid * scores, 600.0))) + (1 - float(p.sum())) * math.exp(mid * model.miss)
        low, up = (mid, up) if total < 1 else (low, mid)
    return (low + up) / 2


def _segments_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hits = Hits(model.weights)
        for b in batches:
            sizes, weights, scores = [], [], []
            for words in _words(b):
                at, own, found = located(words, hits, model)
                sizes.append(len(words)), weights.append(own), scores.append([s for _, _, s in found])
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array(sizes, pa.int64()), pa.array(weights, pa.list_(pa.float64())), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "n_words", "hits", "found"]
            )

    return run


def _evidence_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = zip(b.column("n_words").to_pylist(), b.column("found").to_pylist(), strict=True)
            x = [round(evidence(n, found, model)[0] * 5) / 5 for n, found in rows]  # at most 401 values
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("toxic")], ["x", "toxic"])

    return run


def _logistic(bins: list[tuple[float, int, int]], ridge: float = 0.01) -> tuple[float, float]:
    """Newton steps for a ridge logistic fit of one feature."""
    x = np.array([[1.0, b[0]] for b in bins])
    y, n = np.array([float(b[1]) for b in bins]), np.array([float(b[2]) for b in bins])
    w = np.zeros(2)
    penalty = np.diag([0.0, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - penalty @ w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _score_rows(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hits = Hits(model.weights)
        for b in batches:
            score, top, count, passages = [], [], [], []
            for words in _words(b):
                x, found, n = scored(words, hits, model)
                score.append(probability(x, model))
                top.append(max((s for _, _, s in found), default=0.0))
                count.append(n)
                passages.append([{"start": s, "end": e, "score": v} for s, e, v in found])
            cols = [b.column("doc_id"), pa.array(score, pa.float64()), pa.array(top, pa.float64()), pa.array(count, pa.int32())]
            names = ["doc_id", "score", "top_segment", "n_passages"]
            if spans:
                cols.append(pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1), top_segment, n_passages and, with `spans`, the passages as word
    ranges. Null and empty texts have no segment and get the lowest score. Repeated rows score alike."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = "doc_id long, score double, top_segment double, n_passages int" + ", passages array<struct<start:int,end:int,score:double>>" * spans
    return rows.mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast(model), spans), shape)


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `least` or more; every column stays, and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hits = Hits(m.weights)
        for b in batches:
            yield b.filter(pa.array([probability(scored(w, hits, m)[0], m) < least for w in _words(b, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
