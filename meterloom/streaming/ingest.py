"""Streaming ingestion: drafts to records, and micro-batches committed to a ledger.

A micro-batch is one commit under the number that its stream gave it; one that was committed before a failure is left as it
is when the stream runs it again. Late corrections are never dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import clean, content_hash, cost_problem, countable, dedupe_key, display_total, parse_timestamp, record_id, timestamp_kind
from .ledger import Ledger, Scope, State

COUNTS = ("input", "output", "cached_input", "reasoning")
CLEANED = ("source_event_id", "raw_timestamp", "provider", "model", "project", "session_id", "pricing_version")
CONTENT = ("raw_timestamp", "provider", "model", *COUNTS, "reported_total", "project", "session_id")
COST = ("cost_status", "pricing_version", "amount_minor", "currency", "exponent")


def reject_reason() -> Column:
    """Why a draft can't be a record, or null: source, negative counts, a quality that contradicts its count, cost."""
    negative = F.greatest(*(F.when(F.col(c) < 0, 1).otherwise(0) for c in (*COUNTS, "reported_total"))) == 1
    off = F.lit(False)
    for c in COUNTS:
        known = F.coalesce(F.col(f"{c}_quality"), F.when(F.col(c).isNotNull(), "exact").otherwise("unknown")) != "unknown"
        off |= F.col(c).isNotNull() != known
    return F.when(F.col("source_app").isNull(), "no source").when(negative, "negative count").when(off, "inconsistent token quality").otherwise(cost_problem(*map(F.col, COST)))


def normalized(drafts: DataFrame) -> DataFrame:
    """Drafts as records: identity, content hash, instant and display total; `reject_reason` says why a draft isn't one.

    A count without a quality is exact where it is known; currencies are upper-cased, texts stored without white space
    around them, blank ones as null.
    """
    value = lambda c: F.when(F.col(f"{c}_quality").isNull(), F.col(c)).otherwise(countable(F.col(c), F.col(f"{c}_quality")))
    drafts = drafts.withColumns({c: clean(F.col(c)) for c in CLEANED} | {"currency": F.upper("currency")})
    out = drafts.withColumns(
        {
            "dedupe_key": dedupe_key(F.col("source_app"), F.col("source_event_id"), *map(F.col, CONTENT)),
            "content_hash": content_hash(
                F.col("raw_timestamp"), F.col("provider"), F.col("model"), [(F.col(c), F.col(f"{c}_quality")) for c in COUNTS], F.col("reported_total"), F.col("project"), F.col("session_id"), tuple(map(F.col, COST))
            ),
            "timestamp_interpretation": timestamp_kind(F.col("raw_timestamp")),
            "event_ts": parse_timestamp(F.col("raw_timestamp")),
            "display": display_total(F.col("reported_total"), value("input"), value("output"), value("reasoning")),
            "reject_reason": reject_reason(),
        }
    )
    return out.withColumn("id", record_id(F.col("source_app"), F.col("dedupe_key")))


#: What a parser makes of one batch of lines: drafts, and checkpoints of its units where it carries any.
Parser = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


def ingest(drafts: DataFrame, ledger: Ledger, checkpoint: str, hours: bool = True) -> StreamingQuery:
    """Runs a stream of drafts into the ledger until what is there has been read; totals by the hour follow always."""
    return _commits(drafts, lambda df, held: (df, None), ledger, checkpoint)


def ingest_lines(tail: DataFrame, drafts: Callable[[DataFrame], DataFrame], ledger: Ledger, checkpoint: str, hours: bool = True) -> StreamingQuery:
    """Runs appended lines (`sources.tail`) into the ledger; `drafts` reads those of one batch (path, line_no, value).

    A message that goes on in a later batch corrects its record.
    """
    return ingest_parsed(tail, lambda df, held: (drafts(df), None), ledger, checkpoint)


def ingest_parsed(tail: DataFrame, parser: Parser, ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Like `ingest_lines`, for a parser whose state goes on from batch to batch: what it has reached in each file is a
    checkpoint of the ledger, committed together with the records."""
    return _commits(tail.withColumnRenamed("at", "line_no"), parser, ledger, checkpoint)


def _commits(stream: DataFrame, parser: Parser, ledger: Ledger, checkpoint: str) -> StreamingQuery:
    def commit(df: DataFrame, n: int) -> None:
        if not ledger.holds(checkpoint, n):
            drafts, checkpoints = parser(df, ledger.at().checkpoints())
            ledger.commit(normalized(drafts), checkpoints=checkpoints, stream=(checkpoint, n))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_totals(ledger: Ledger) -> DataFrame:
    """Hourly totals of the current records by source, folded from what the commits have added and taken away."""
    hours = ledger.at().hours()
    tokens = F.when(F.sum("display_counted") > 0, F.sum("display")).cast("long")
    return hours.filter("hour_start is not null").groupBy("source_app", "hour_start").agg(F.sum("records").alias("n"), tokens.alias("tokens"))


__all__ = ["Ledger", "Scope", "State", "hourly_totals", "ingest", "ingest_lines", "ingest_parsed", "normalized", "reject_reason"]
