"""Re-Pair over a table of symbol sequences: rounds of counted adjacent pairs, each frequent one replaced by a rule."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A rule is a pair of symbols; rule k is the symbol `first + k`.
Rules = list[tuple[int, int]]


def replaced(symbols: list[int], of: dict[tuple[int, int], int]) -> list[int]:
    """`symbols` with each pair that has a rule replaced by it, from left to right, pairs not overlapping."""
    out, k = [], 0
    while k < len(symbols):
        rule = of.get((symbols[k], symbols[k + 1])) if k + 1 < len(symbols) else None
        out.append(symbols[k] if rule is None else rule)
        k += 1 if rule is None else 2
    return out


def compress(sequences: DataFrame, scratch: Scratch, first: int, rounds: int, per_round: int, column: str = "symbols") -> tuple[DataFrame, Rules]:
    """`sequences` with its array of ints `column` compressed, and the rules, whose parts are always older symbols.

    Each round counts all adjacent pairs of all sequences as a Spark aggregation and takes the `per_round` most frequent
    ones that occur at least twice, so that the driver holds at most `rounds * per_round` rules. Which pairs become rules
    decides only how much is shared, never what a sequence stands for.
    """
    rules: Rules = []
    schema = sequences.schema
    pair = F.explode(F.expr(f"transform(sequence(1, size({column}) - 1), i -> struct({column}[i - 1] AS l, {column}[i] AS r))"))
    for n in range(rounds):
        counted = sequences.filter(F.size(column) > 1).select(pair.alias("p")).groupBy("p.l", "p.r").agg(F.count("*").alias("n")).filter("n > 1")
        frequent = counted.orderBy(F.desc("n"), "l", "r").limit(per_round).collect()
        if not frequent:
            break
        of = {(p["l"], p["r"]): first + len(rules) + k for k, p in enumerate(frequent)}
        rules += list(of)

        def run(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(column)
                new = pa.array([replaced(s, of) for s in batch.column(at).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

        sequences = scratch.save(sequences.mapInArrow(run, schema), f"grammar-{n}")
        if n:
            scratch.drop(f"grammar-{n - 1}")
    return sequences, rules
