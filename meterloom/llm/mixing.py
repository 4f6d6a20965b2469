"""Mixing sources to target weights by entropy balancing.

Sources in code-point order (null last) carry the weights 3, 1, 2, repeating, and share a token budget; no source takes
more than `cap` times its own size, and what it can't take is shared again by weight. Each document then gets the rate
that stays closest to one in Kullback-Leibler divergence while its source meets its token constraint and no rate
exceeds `cap`: r = min(cap, exp(a * size / mean size)). The multiplier `a` of each source solves a convex dual problem;
Newton iterations (kept inside a bracket) run for all sources at once over a (source, size) histogram, as one
aggregation each. Sources are a table like any other, of any length. Rates become whole copies by error diffusion, largest documents first, in blocks of a bounded number
of documents, so that a hot source spreads over many tasks.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, Scratch, fresh

#: Documents of one rounding block.
BLOCK_ROWS = 4096
WEIGHTS = (3, 1, 2)


def water_level(sources: DataFrame, budget: Fraction, cap: int) -> Fraction | None:
    """Tokens for each unit of weight, so that all targets, held at `cap` times the size, make up the budget.

    A source is over its cap as soon as its share is, and shares only grow while what is over is shared again, so the
    level alone tells which sources are over; each step is one sum over the sources. None where all are over.
    """
    level = budget / (sources.agg(F.sum("weight")).first()[0] or 1)
    many = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    seen = -1
    while True:
        over = above_cap(level, cap)
        full, weight, size = sources.agg(F.count_if(over), F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, F.col("source_size").cast("decimal(38,0)")) * many(cap))).first()
        if weight is None:
            return None
        if full == seen:
            return level
        seen, level = full, (budget - int(size or 0)) / int(weight)


def above_cap(level: Fraction, cap: int) -> Column:
    many = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    return F.col("weight") * many(level.numerator) > F.col("source_size") * many(level.denominator * cap)


def word_counts(batches):
    import pyarrow as pa

    for b in batches:
        n = [len(x.split()) for x in b.column("text").cast(pa.binary()).to_pylist()]
        names = [f.name for f in b.schema if f.name != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64())], [*names, "size"])


assert WHITE.split() == []  # bytes.split() parts words at exactly these six bytes


def _planned(sized: DataFrame, scratch: Scratch, share: Fraction, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row for each source: its number in code-point order (null last), size, mean, blocks, target."""
    order = F.col("source").asc_nulls_last()
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = scratch.save(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    runs = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))  # one row for each range
    runs = runs.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("at") - F.col("first")
    numbered = ordered.withColumn("part", part).join(runs, "part").withColumn("source_ix", number).withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("source_ix") % len(weights)).cast("int")))
    sources = scratch.save(numbered.select("source_ix", "source", "source_size", "n_docs", "weight"), "sources")
    level = water_level(sources, share * int(sources.agg(F.sum("source_size")).first()[0] or 0), cap)
    target = (F.col("source_size") * cap).cast("double")
    if level is not None:
        shared = F.lit(0.0)
        for w in set(weights):
            shared = F.when(F.col("weight") == w, F.lit(float(level * w))).otherwise(shared)
        target = F.when(above_cap(level, cap), target).otherwise(shared)
    mean = F.greatest(F.lit(1.0), F.col("source_size") / F.col("n_docs"))
    return sources.select("source_ix", "source", "source_size", mean.alias("mean"), F.ceil(F.col("n_docs") / BLOCK_ROWS).alias("blocks"), target.alias("target"))


def _solve(histogram: DataFrame, plan: DataFrame, scratch: Scratch, cap: int, rounds: int, tolerance: float) -> DataFrame:
    """`plan` with the multiplier `a` of each source, by Newton steps inside a bracket; sources at their cap or at 0 need
    none. Each round is one written table; after all rounds a bracket is narrower than a double can tell."""
    open_ = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size"))
    zero = F.lit(0.0)
    now = scratch.save(plan.withColumns({"a": zero, "low": F.lit(-60.0), "high": F.lit(60.0), "open": open_}), "solve-0")
    whole = lambda c: F.sum(F.round(c * 1024).cast("decimal(38,0)")).cast("double")  # noqa: E731  exact sums: reruns agree
    for k in range(1, rounds + 1):
        if now.filter("open").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        tilt = F.least(F.exp(F.least(F.col("a") * x, F.lit(50.0))), F.lit(float(cap)))
        tokens = F.col("size") * F.col("n")
        sums = histogram.join(now.filter("open").select("source_ix", "a", "mean"), "source_ix").groupBy("source_ix")
        sums = sums.agg((whole(tokens * tilt) / 1024).alias("have"), (whole(F.when(tilt < cap, tokens * tilt * x).otherwise(0.0)) / 1024).alias("slope"))
        gap, a = F.col("have") - F.col("target"), F.col("a")
        low, high = F.when(gap <= 0, a).otherwise(F.col("low")), F.when(gap > 0, a).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, a - gap / F.col("slope"))
        settled = F.abs(gap) <= tolerance * F.col("target")
        moved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        is_open = F.col("open") & ~F.coalesce(settled, F.lit(True))
        after = now.join(sums, "source_ix", "left").withColumns({"a": F.when(is_open, moved).otherwise(a), "low": F.when(is_open, low).otherwise(F.col("low")), "high": F.when(is_open, high).otherwise(F.col("high")), "open": is_open})
        after = scratch.save(after.select(now.columns), f"solve-{k}")
        scratch.drop(f"solve-{k - 1}")
        now = after
    return now.select(*plan.columns, "a", (F.col("target") >= cap * F.col("source_size")).alias("full"))


def _round_block(cap: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Whole copies whose words follow the rates: the error so far moves to the next document, large ones first."""
        block = block.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], na_position="last", kind="stable")
        owed, copies = 0.0, []
        for size, rate in zip(block["size"], block["rate"], strict=True):
            owed += rate * size
            n = min(cap, max(0, int(owed / size + 0.5))) if size else 0
            owed -= n * size
            copies.append(n)
        return block.assign(copies=copies)[["row", "doc_id", "source_ix", "size", "rate", "copies"]]

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: Fraction = Fraction(3, 2),
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = 2,
    rounds: int = 80,
    tolerance: float = 1e-6,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, rate, copies, taken.

    With `row_col`, a column of whole numbers that differ between rows, they come as a last column `row`.

    Null texts have size 0; a document without words takes nothing. A null source is one of its own, after all others.
    Repeated ids are rows like any others. An empty table gives an empty result. The same rows give the same copies; rows
    without an id are told apart by their place, so which of them are copied may change with how the table is dealt.
    Texts are only counted, batch by batch, so a very long one costs its own size once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    row = (docs[row_col] if row_col else F.monotonically_increasing_id()).cast("long").alias("row")
    base = docs.select(row, docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sized = scratch.save(base.mapInArrow(word_counts, "row long, doc_id long, source string, size long"), "sized")
    plan = scratch.save(_planned(sized, scratch, share, weights, cap), "plan")
    names = plan.select(F.col("source").alias("named"), "source_ix", "blocks")
    keyed = sized.join(names, sized["source"].eqNullSafe(names["named"])).select("row", "doc_id", "source_ix", "size", "blocks")
    histogram = scratch.save(keyed.filter("size > 0").groupBy("source_ix", "size").agg(F.count("*").alias("n")), "histogram")
    tilt = scratch.save(_solve(histogram, plan, scratch, cap, rounds, tolerance), "tilt")
    scratch.drop("histogram")
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("full") & (F.col("source_size") > 0), F.lit(float(cap))).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.exp(F.least(F.col("a") * x, F.lit(50.0))), F.lit(float(cap))))
    own = F.when(F.col("doc_id").isNull(), F.col("row"))  # rows without an id spread over the blocks
    rated = keyed.join(tilt.select("source_ix", "source_size", "mean", "target", "a", "full"), "source_ix").select("row", "doc_id", "source_ix", "size", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", own), F.col("blocks")).alias("block"))
    copied = rated.groupBy("source_ix", "block").applyInPandas(_round_block(cap), "row long, doc_id long, source_ix long, size long, rate double, copies int")
    return copied.join(tilt.select("source_ix", "source", "source_size", "target"), "source_ix").select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row_col else [])
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each row as often as the mix takes it; every column stays.

    Rows are told apart by a key of their own, so rows without an id and rows that repeat one each get their own copies.
    """
    rows, row = Scratch(docs.sparkSession, "rows").numbered(docs)
    times, copy = fresh(rows, "copies"), fresh(rows, "copy")
    copies = mix(rows, row_col=row, **options).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    return rows.join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
