"""Filters, totals, groupings, threads, recent lists and commit semantics over usage records."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div, record_id
from ..schema import BIGINT_MAX, LIMIT_DEFAULT, LIMIT_MAX, MAX_EXPONENT

COUNTS = ("input", "output", "cached_input", "reasoning", "display")


@dataclass(frozen=True)
class Filter:
    """None lets everything pass; an empty list nothing. Any date bound leaves undated rows out."""

    sources: tuple[str, ...] | None = None
    models: tuple[str, ...] | None = None
    since: datetime | None = None
    until: datetime | None = None

    def __post_init__(self):
        if self.since is not None and self.until is not None and self.until <= self.since:
            raise ValueError("until must lie after since")

    def without_dates(self) -> Column:
        out = F.lit(True)
        for column, allowed in (("source_app", self.sources), ("model", self.models)):
            if allowed is not None:
                out &= F.coalesce(F.col(column).isin(*allowed), F.lit(False)) if allowed else F.lit(False)
        return out

    def dates(self) -> Column:
        out = F.lit(True)
        if self.since is not None:
            out &= F.col("event_ts") >= F.lit(self.since).cast("timestamp_ntz")
        if self.until is not None:
            out &= F.col("event_ts") < F.lit(self.until).cast("timestamp_ntz")
        return out

    def apply(self, records: DataFrame) -> DataFrame:
        return records.filter(self.without_dates() & self.dates())


def capped(total: Column) -> Column:
    """A sum without overflow, held at the largest long."""
    return F.least(F.coalesce(total, F.lit(0)), F.lit(BIGINT_MAX).cast("decimal(38,0)")).cast("long")


def total_columns() -> list[Column]:
    """Rows, and for each count its sum over known values and how many rows know it or don't."""
    out = [F.count("*").alias("records")]
    for c in COUNTS:
        out += [capped(F.sum(F.col(c).cast("decimal(38,0)"))).alias(c), F.count(c).alias(f"{c}_counted"), (F.count("*") - F.count(c)).alias(f"{c}_unknown")]
    return [*out, (F.count("*") - F.count("amount_minor")).alias("records_without_cost")]


def totals(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(*total_columns())


def totals_all_levels(records: DataFrame) -> DataFrame:
    """The three levels of a summary in one pass; `level` tells an unknown model from a rolled-up one."""
    from pyspark.sql.functions import grouping_id

    sets = records.groupingSets([[], ["source_app"], ["model"]], "source_app", "model")
    level = F.when(grouping_id() == 3, "all").when(grouping_id() == 1, "source").otherwise("model")
    return sets.agg(level.alias("level"), *total_columns())


def cost_by_currency(records: DataFrame, *by: str) -> DataFrame:
    """Exact sums, never across currencies, at the largest exponent seen."""
    scaled = F.sum(F.col("amount_minor").cast("decimal(38,0)") * F.pow(F.lit(10), MAX_EXPONENT - F.col("exponent")).cast("decimal(10,0)"))
    top = F.max("exponent")
    summed = records.filter("amount_minor is not null").groupBy(*by, "currency").agg(scaled.alias("scaled"), top.cast("int").alias("exponent"), F.count("*").alias("counted"))
    return summed.select(*by, "currency", capped(div(F.col("scaled"), F.pow(F.lit(10), MAX_EXPONENT - F.col("exponent")).cast("decimal(10,0)"))).alias("amount_minor"), "exponent", "counted")


def undated_excluded(records: DataFrame, wanted: Filter) -> DataFrame:
    bounded = wanted.since is not None or wanted.until is not None
    return records.filter(wanted.without_dates()).agg(F.count_if(F.col("event_ts").isNull() & F.lit(bounded)).alias("undated_excluded"))


def effective_limit(n: int | None) -> int:
    return min(LIMIT_MAX, max(1, LIMIT_DEFAULT if n is None else n))


def recent(records: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first; undated rows last, by import time where that is known; ties by record id."""
    undated = F.col("event_ts").isNull()
    at = F.coalesce("event_ts", F.col("imported_at")) if "imported_at" in records.columns else F.col("event_ts")
    return records.orderBy(undated, at.desc(), record_id(F.col("source_app"), F.col("dedupe_key"))).limit(effective_limit(n))


def ordered_groups(groups: DataFrame, label: str) -> DataFrame:
    """Groups by falling display total, then by label."""
    return groups.orderBy(F.desc("display"), label)


def date_span(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.min("event_ts").alias("first_event"), F.max("event_ts").alias("last_event"))


def last_days(now: datetime, days: int = 30, source: str | None = None) -> Filter:
    """The dashboard's default filter."""
    return Filter(sources=None if source is None else (source,), since=now - timedelta(days=days))


def threads(records: DataFrame) -> DataFrame:
    """One row per (source, session): totals, models, first and last event, and the project of the latest row that has one.

    A dated row's project is taken before an undated one's; ties go to the larger event id.
    """
    dated = lambda c: F.max_by("project", F.when(c & F.col("project").isNotNull(), F.struct(F.coalesce("event_ts", F.lit(datetime(1, 1, 1)).cast("timestamp_ntz")), "event_id")))
    has = F.col("event_ts").isNotNull()
    return (
        records.filter("session_id is not null")
        .groupBy("source_app", "session_id")
        .agg(
            *total_columns(),
            F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
            F.min("event_ts").alias("first_event"),
            F.max("event_ts").alias("last_event"),
            F.coalesce(dated(has), dated(~has)).alias("project"),
        )
    )


def top_threads(records: DataFrame, n: int | None = None) -> DataFrame:
    return threads(records).orderBy(F.desc("display"), F.desc_nulls_last("last_event"), "source_app", "session_id").limit(effective_limit(n))


def threads_header(records: DataFrame) -> DataFrame:
    """Of all threads, whatever the list shows: their number and tokens, and the records that belong to none."""
    own = F.col("session_id").isNotNull()
    return records.agg(
        F.count_distinct(F.when(own, F.struct("source_app", "session_id"))).alias("thread_count"),
        capped(F.sum(F.when(own, F.col("display")).cast("decimal(38,0)"))).alias("attributed_tokens"),
        F.count_if(~own).alias("unattributed"),
    )


def share_of_total(records: DataFrame, by: str) -> DataFrame:
    """Tokens of each group and thousandths of the whole, 0 where the whole is 0."""
    groups = records.groupBy(by).agg(capped(F.sum(F.col("display").cast("decimal(38,0)"))).alias("tokens"))
    whole = records.agg(F.coalesce(F.sum(F.col("display").cast("decimal(38,0)")), F.lit(0)).alias("whole"))  # one row
    return groups.crossJoin(F.broadcast(whole)).select(by, "tokens", F.coalesce(div(F.col("tokens") * F.lit(1000).cast("decimal(10,0)"), F.col("whole")).cast("long"), F.lit(0)).alias("share_tenths"))


# commits -------------------------------------------------------------------------------------------------------------
def classify(batch: DataFrame, store: DataFrame) -> DataFrame:
    """`batch` (dedupe_key, content_hash, seq) with the outcome of each row applied in order to `store`.

    A row is unchanged if its hash equals the one before it under its key, in the batch or else in the store; otherwise
    it is inserted where nothing stood before, and updated where something did.
    """
    held = store.select("dedupe_key", F.col("content_hash").alias("stored_hash"))
    w = Window.partitionBy("dedupe_key").orderBy("seq")
    joined = batch.join(held, "dedupe_key", "left").withColumn("before", F.coalesce(F.lag("content_hash").over(w), "stored_hash"))
    return joined.withColumn("outcome", F.when(F.col("before").isNull(), "inserted").when(F.col("before") == F.col("content_hash"), "unchanged").otherwise("updated"))


def merged(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The store after the batch: the last row that changed a key wins, unchanged rows keep what was there.

    Store and batch meet in one aggregation by key, in which a key's row of the batch counts as later than the stored one.
    """
    changed = classify(batch, store).filter("outcome <> 'unchanged'")
    row = F.struct(*store.columns)
    both = changed.select("dedupe_key", F.col("seq").alias("seq"), F.lit(1).alias("new"), row.alias("row")).unionByName(store.select("dedupe_key", F.lit(None).cast(batch.schema["seq"].dataType).alias("seq"), F.lit(0).alias("new"), row.alias("row")))
    return both.groupBy("dedupe_key").agg(F.max_by("row", F.struct("new", "seq")).alias("row")).select("row.*")


def outside_scope(store: DataFrame, batch: DataFrame, source: str, since: datetime, until: datetime) -> DataFrame:
    """The store without the dated rows of `source` in [since, until) that the batch doesn't report again."""
    inside = (F.col("source_app") == source) & (F.col("event_ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("event_ts") < F.lit(until).cast("timestamp_ntz"))
    gone = store.filter(F.coalesce(inside, F.lit(False))).join(batch.select("dedupe_key"), "dedupe_key", "left_anti").select("dedupe_key")
    return store.join(gone, "dedupe_key", "left_anti")
