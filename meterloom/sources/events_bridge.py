"""Usage records and allowance samples derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import dedupe_key, display_total, div
from ..operators.units import cost_units
from ..schema import SOURCES


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage record for each event: unknown counts are null, a fiftieth of the rows is undated."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, kind = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    e = e.withColumns({"k": k, "c": F.round(F.col("value") * 100).cast("long")})
    c, k = F.col("c"), F.col("k")
    bought = kind == "purchase"
    priced = bought | ((kind == "view") & (k % 5).isin(0, 1))
    out = e.select(
        "event_id",
        "ts",
        F.when(F.col("user_id") % 3 == 0, SOURCES[0]).when(F.col("user_id") % 3 == 1, SOURCES[1]).otherwise(SOURCES[2]).alias("source_app"),
        F.when(kind != "signup", F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session_id"),
        F.when(k % 7 != 0, F.concat(F.lit("p"), (k % 6).cast("string"))).alias("project"),
        F.when(kind == "click", "haiku-1").when(kind == "view", "sonnet-1").when(bought, "opus-1").when(kind == "signup", "o4-mini").alias("model"),
        F.when(kind != "error", c).alias("input"),
        F.when(kind != "error", k).alias("output"),
        F.when(k % 4 != 0, c * 3).alias("cached_input"),
        F.when(F.col("user_id") % 3 == 2, k * 2).alias("reasoning"),
        F.when(k % 10 == 0, c + k + 7).alias("reported"),
        F.when(bought, c * 100).when(priced, c).alias("amount_minor"),
        F.when(bought | ((kind == "view") & (k % 5 == 1)), "USD").when(priced, "EUR").alias("currency"),
        F.when(bought, 4).when(priced, 2).alias("exponent"),
        F.when(k % 50 != 0, F.col("ts")).alias("event_ts"),
    )
    own = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    return out.withColumns({"display": display_total(*map(F.col, ("reported", "input", "output", "reasoning"))), "dedupe_key": dedupe_key(F.col("source_app"), own)})


def samples(records: DataFrame, pools: bool = False) -> DataFrame:
    """Change-only readings of a daily allowance of each source, driven by cost units.

    With `pools`, the first source has two allowances, told apart by their labels: one for its small models, one for all
    others. Units run on within a minute of an allowance; what came before it that day is a running sum over its minutes,
    of which a day has 1440, so no task holds a day's events. The reading before an event's own is that of the units
    before it, so no event looks at another.
    """
    pool = F.when(F.col("source_app") == SOURCES[0], F.when(F.col("model").isin("haiku-1", "o4-mini"), "Small models").otherwise("Other models")) if pools else F.lit(None).cast("string")
    key = ["source_app", "pool", "day"]
    metered = records.select("source_app", F.coalesce(pool, F.lit("")).alias("pool"), F.to_date("ts").alias("day"), F.date_trunc("minute", "ts").alias("minute"), "ts", "event_id", cost_units(F.col("model"), F.col("input"), F.col("output"), F.col("cached_input")).alias("units"))
    day = Window.partitionBy(*key)
    upto = day.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = metered.groupBy(*key, "minute").agg(F.sum("units").alias("of_minute"))
    minutes = minutes.select(*key, "minute", F.coalesce(F.sum("of_minute").over(upto), F.lit(0)).alias("before"), F.sum("of_minute").over(day).alias("whole"), (F.row_number().over(day.orderBy("minute")) == 1).alias("opens"))
    w = Window.partitionBy(*key, "minute").orderBy("ts", "event_id")
    run = F.col("before") + F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, 0))
    read = metered.join(minutes, [*key, "minute"]).withColumns({"run": run, "first": F.col("opens") & (F.row_number().over(w) == 1)})
    share = lambda units: F.coalesce(div(1000 * units, F.col("whole")), F.lit(0))
    return (
        read.withColumns({"used": share(F.col("run")), "earlier": share(F.col("run") - F.col("units"))})
        .filter("first or earlier <> used")
        .select("source_app", F.nullif("pool", F.lit("")).alias("label"), F.lit(1440).cast("long").alias("window_minutes"), "used", F.date_add("day", 1).cast("timestamp_ntz").alias("resets_at"), F.col("ts").alias("observed_at"), "event_id")
    )
