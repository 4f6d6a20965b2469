"""What a store keeps beside records: allowances, their samples, sync health, revisions, change rows and fired alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import same_instance
from ..schema import METRICS, SOURCES, WEEK_MINUTES, named
from .series import KEY, at, pooled

#: How far a delta reads back, and how far a reconciliation does; a source's limit where none is set; the
#: largest limit of each metric; what kinds of errors mean that a source can't be reached.
OVERLAP, RECONCILE, SAMPLE_DAYS = timedelta(hours=6), timedelta(days=30), 62
DEFAULT_METRIC, DEFAULT_LIMIT = "remaining_percent", 25
LARGEST_LIMIT = {"remaining_percent": 100, "minutes_until_reset": WEEK_MINUTES, "projected_exhaustion": WEEK_MINUTES}
UNREACHABLE = ("offline", "rate_limited")


def merged_quotas(stored: DataFrame, incoming: DataFrame, source: str | None = None) -> DataFrame:
    """The newest reading of each allowance; on equal times the stored one stays.

    With `source`, the incoming readings replace that source's: its windows that aren't among them go.
    """
    old, new = pooled(stored).withColumn("new", F.lit(0)), pooled(incoming).withColumn("new", F.lit(1))
    if source is not None:
        gone = old.filter(F.col("source_app") == source).join(new.select(*KEY), KEY, "left_anti").select(*KEY)
        old = old.join(gone, KEY, "left_anti")
    columns = [c for c in stored.columns if c not in KEY]
    newest = old.unionByName(new).groupBy(*KEY).agg(F.max_by(F.struct(*columns), F.struct("observed_at", -F.col("new"))).alias("q"))
    return newest.select("source_app", "window_minutes", "q.*")


def changed_samples(quotas: DataFrame, newest: DataFrame) -> DataFrame:
    """The quotas that differ from the newest sample of their window in value or in instance, or have none."""
    mark = pooled(newest).select(*KEY, F.struct("used_tenths", "resets_at").alias("mark"))
    same = (F.col("mark.used_tenths") == F.col("used_tenths")) & same_instance(F.col("mark.resets_at"), F.col("resets_at"))
    return pooled(quotas).join(mark, KEY, "left").filter(F.col("mark").isNull() | ~F.coalesce(same, F.lit(False))).drop("mark", "pool")


def next_health(stored: DataFrame, attempts: DataFrame, now: datetime) -> DataFrame:
    """Stored health after one attempt of some sources, by the rules of `health_history`; `material` tells what has changed."""
    held = stored.select("source_app", F.struct("state", "app_synced_at", "source_observed_at", "last_error", "awaiting_upstream", "last_attempt_at").alias("h"))
    a = attempts.select("source_app", F.struct("outcome", "observed_at", F.coalesce("awaiting", F.lit(False)).alias("awaiting"), "error").alias("a"))
    both, t = held.join(a, "source_app", "full"), F.lit(now).cast("timestamp")
    kind, tried = F.col("a.outcome"), F.col("a").isNotNull()
    good, bad = F.coalesce(kind == "succeeded", F.lit(False)), F.coalesce(kind.isin("offline", "failed"), F.lit(False))
    fields = {
        "state": F.when(good, "current").when(kind == "started", "syncing").when(kind == "offline", "offline").when(kind == "failed", "error").otherwise(F.col("h.state")),
        "app_synced_at": F.when(good, t).otherwise(F.col("h.app_synced_at")),
        "source_observed_at": F.when(good, F.coalesce("a.observed_at", "h.source_observed_at", t)).otherwise(F.col("h.source_observed_at")),
        "last_error": F.when(bad, F.col("a.error")).when(~good, F.col("h.last_error")),
        "awaiting_upstream": F.when(good, F.col("a.awaiting")).otherwise(F.coalesce("h.awaiting_upstream", F.lit(False))),
    }
    out = both.withColumns(fields).withColumn("last_attempt_at", F.when(tried, t).otherwise(F.col("h.last_attempt_at")))
    same = F.col("h").isNotNull()
    for c in fields:
        same &= F.col(c).eqNullSafe(F.col(f"h.{c}"))
    return out.select("source_app", "state", "last_attempt_at", *list(fields)[1:], (~same).alias("material"))


def pruned_samples(samples: DataFrame, now: datetime) -> DataFrame:
    return samples.filter(F.col("observed_at") >= at(now - timedelta(days=SAMPLE_DAYS)))


def delta_window(watermark: datetime | None, now: datetime, reconcile: bool = False) -> tuple[datetime, datetime]:
    """What a billed feed is read again for: from six hours before the watermark, at most thirty days."""
    least = now - RECONCILE
    return (least if reconcile or watermark is None else max(least, watermark - OVERLAP)), now


def awaiting_upstream(local: DataFrame, published: DataFrame) -> DataFrame:
    """Whether local activity is newer than all that has been published, or nothing has been."""
    newest = local.agg(F.max("event_ts").alias("local")).crossJoin(published.agg(F.max("event_ts").alias("published")))  # one row each
    return newest.select(F.coalesce(F.col("local").isNotNull() & (F.col("published").isNull() | (F.col("local") > F.col("published"))), F.lit(False)).alias("awaiting_upstream"))


def without_placeholders(records: DataFrame, live_ref: str = "local-activity") -> DataFrame:
    """Records without the live rows that the billed feed of their source has passed."""
    live = F.coalesce(F.col("source_ref") == live_ref, F.lit(False))
    newest = records.filter(~live).groupBy("source_app").agg(F.max("event_ts").alias("passed"))
    return records.join(newest, "source_app", "left").filter(~(live & F.coalesce(F.col("event_ts") <= F.col("passed"), F.lit(False)))).drop("passed")


def health_history(attempts: DataFrame) -> DataFrame:
    """The health of each source after each of its attempts (source_app, seq, at, outcome, observed_at, awaiting, error).

    `outcome` is started, succeeded, offline or failed. A success moves the clock of reading, and that of the source only
    where it brings an observation (the first success stands in for one); a failure keeps both and leaves its error until
    the next success. `material` says that something other than the time of the attempt has changed, `revision` counts
    these changes.
    """
    w = Window.partitionBy("source_app").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    good, bad = F.col("outcome") == "succeeded", F.col("outcome").isin("offline", "failed")
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    fields = {
        "state": F.when(good, "current").when(F.col("outcome") == "started", "syncing").when(F.col("outcome") == "offline", "offline").otherwise("error"),
        "app_synced_at": last(F.when(good, F.col("at"))),
        "source_observed_at": F.coalesce(last(F.when(good, F.col("observed_at"))), F.first(F.when(good, F.col("at")), ignorenulls=True).over(upto)),
        "last_error": last(F.when(bad, F.struct(F.col("error").alias("e"))).when(good, F.struct(F.lit(None).cast("string").alias("e"))))["e"],
        "awaiting_upstream": F.coalesce(last(F.when(good, F.coalesce("awaiting", F.lit(False)))), F.lit(False)),
    }
    out = attempts.withColumns(fields)
    same = F.row_number().over(w) > 1
    for c in fields:
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    out = out.withColumn("material", ~same).withColumn("revision", F.sum(F.col("material").cast("long")).over(upto))
    return out.select("source_app", "seq", F.col("at").alias("last_attempt_at"), *fields, "material", "revision")


def change_rows(outcomes: DataFrame) -> DataFrame:
    """What a commit publishes of each source: how many records it inserted, updated and left, and whether data changed."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("source_app").agg(n("inserted").alias("inserted"), n("updated").alias("updated"), n("unchanged").alias("unchanged"), (n("unchanged") < F.count("*")).alias("data_changed"))


def outcome_of(error_kind: Column) -> Column:
    """How an attempt ended, by the kind of its error: null is a success, an unreachable source is offline."""
    return F.when(error_kind.isNull(), "succeeded").when(error_kind.isin(*UNREACHABLE), "offline").otherwise("failed")


def limits(options: DataFrame) -> DataFrame:
    """One limit for each source, of options (seq, source_app, metric, limit_value, enabled): the last one, or the default.

    Options of other sources are left out. `problem` says why a limit can't be taken: its metric is unknown, or its value
    negative or too large for it.
    """
    spark = options.sparkSession
    last = options.groupBy("source_app").agg(F.max_by(F.struct("metric", "limit_value", "enabled"), "seq").alias("o"))
    every = spark.createDataFrame([(s,) for s in SOURCES], "source_app string").join(last, "source_app", "left")
    usual = F.struct(F.lit(DEFAULT_METRIC).alias("metric"), F.lit(DEFAULT_LIMIT).cast("long").alias("limit_value"), F.lit(True).alias("enabled"))
    o = every.select("source_app", F.coalesce("o", usual).alias("o")).select("source_app", "o.*")
    inside = F.coalesce(F.col("limit_value").between(0, named(F.col("metric"), LARGEST_LIMIT)), F.lit(False))
    return o.withColumn("problem", F.when(~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False)), "unknown metric").when(~inside, "limit out of range"))


def to_fire(active: DataFrame, fired: DataFrame) -> DataFrame:
    """Active alerts that haven't been shown for their window instance."""
    return active.join(fired.select("alert_key"), "alert_key", "left_anti")


def live_keys(fired: DataFrame, live: DataFrame) -> DataFrame:
    """The fired or snoozed keys whose window instance still runs."""
    return fired.join(live.select("alert_key").distinct(), "alert_key", "left_semi")


def partial_total(unknown: Column) -> Column:
    return unknown > 0
