"""Allowance time series: baselines, burn rates, pace, calibration, projection and session tiling."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import compact_duration, div, format_tenths, micros, minutes_ceil, minutes_floor, round_tenths, same_instance, staleness_limit, window_name
from ..schema import ACTIVE_HOURS, BASELINE_DAYS, BOOTSTRAP_TENTHS, DUTY_LIMIT_MIN, DUTY_UNLOCK, FLOOR_MIN, INSTANCE_TOLERANCE_US, MAX_PROJECTION_MIN, MAX_RESIDUAL, METRICS, MIN_HORIZON_MIN, MIN_SPANS, QUANTUM_TENTHS, RATE_SCALE, SESSION_MINUTES, SLOT_DAYS, SOURCE_TITLES, SOURCES, named
from .units import cost_units


def at(t: datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def burn_rate(records: DataFrame, now: datetime, minutes: int = 60) -> DataFrame:
    """Tokens an hour of each source over the last minutes; rows after now count, silent sources are absent."""
    return records.filter((F.col("event_ts") >= at(now - timedelta(minutes=minutes))) & F.col("display").isNotNull()).groupBy("source_app").agg(div(F.sum("display") * 60, minutes).alias("tokens_per_hour"))


def _cells(records: DataFrame, now: datetime, offset_minutes: int) -> DataFrame:
    local = F.col("event_ts") + F.make_dt_interval(mins=F.lit(offset_minutes))
    return records.filter((F.col("event_ts") >= at(now - timedelta(days=BASELINE_DAYS))) & F.col("display").isNotNull()).groupBy("source_app", F.to_date(local).alias("day"), F.hour(local).alias("hour")).agg(F.sum("display").alias("tokens"), F.min("event_ts").alias("earliest"))


def baseline(records: DataFrame, now: datetime, offset_minutes: int = 0) -> DataFrame:
    """Days seen and, from three days on, the lower median of tokens in each local hour of the day."""
    slot = _cells(records, now, offset_minutes).groupBy("source_app", "hour").agg(F.count("*").alias("n_days"), F.sort_array(F.collect_list("tokens")).alias("each"))  # at most one a day
    return slot.select("source_app", "hour", "n_days", F.when(F.col("n_days") >= SLOT_DAYS, F.get("each", div(F.col("n_days") - 1, 2).cast("int"))).alias("median_tokens"))


def duty_cycle(records: DataFrame, now: datetime, offset_minutes: int = 0) -> DataFrame:
    """Active hours in a hundred of those observed; null below a day of active hours."""
    seen = _cells(records, now, offset_minutes).groupBy("source_app").agg(F.count("*").alias("active_hours"), F.min("earliest").alias("earliest"))
    hours = F.least(F.greatest(div(minutes_floor(F.col("earliest"), at(now)), 60), F.lit(1)), F.lit(BASELINE_DAYS * 24))
    return seen.select("source_app", "active_hours", F.when(F.col("active_hours") >= ACTIVE_HOURS, F.least(div(F.col("active_hours") * 100, hours), F.lit(100))).alias("duty_percent"))


#: What tells allowances apart; `pool` is the label, empty where there is none.
KEY = ["source_app", "pool", "window_minutes"]


def pooled(df: DataFrame) -> DataFrame:
    """`df` with the columns label and pool, whether it has labels or not."""
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
    return df.withColumn("label", label).withColumn("pool", F.coalesce(label, F.lit("")))


def live_quotas(samples: DataFrame, seen_until: datetime, now: datetime) -> DataFrame:
    """The newest reading of each window, if its window is still open."""
    order = F.struct("observed_at", "event_id")
    newest = pooled(samples).filter(F.col("observed_at") <= at(seen_until)).groupBy(*KEY).agg(*(F.max_by(c, order).alias(c) for c in ("label", "used", "resets_at", "observed_at", "event_id")))
    return newest.filter(F.col("resets_at").isNull() | (F.col("resets_at") > at(now)))


def horizons(window: Column, duty: Column) -> Column:
    """Trailing horizons in minutes; a long window has them only for a source that is active nearly always."""
    ladder = F.array_sort(F.array_distinct(F.filter(F.array(F.greatest(div(window, 10), F.lit(MIN_HORIZON_MIN)), F.greatest(div(window, 4), F.lit(MIN_HORIZON_MIN)), F.when(window >= 30, F.greatest(F.least(F.lit(30), div(window, 2)), F.lit(MIN_HORIZON_MIN)))), lambda x: x.isNotNull())))
    return F.when((window <= DUTY_LIMIT_MIN) | (F.coalesce(duty, F.lit(0)) >= DUTY_UNLOCK), ladder).otherwise(F.array().cast("array<bigint>"))


def trailing_runways(quotas: DataFrame, samples: DataFrame, duty: DataFrame) -> DataFrame:
    """(source_app, pool, window_minutes, horizon, runway) of the horizons that show enough movement."""
    q = quotas.join(duty.select("source_app", "duty_percent"), "source_app", "left").withColumn("horizon", F.explode(horizons(F.col("window_minutes"), F.col("duty_percent"))))
    s = pooled(samples).select(*(F.col(c).alias(f"s_{c}") for c in (*KEY, "used", "resets_at", "observed_at", "event_id")))
    within = (micros(F.col("s_observed_at")) >= micros(F.col("observed_at")) - F.col("horizon") * 60_000_000) & (F.col("s_observed_at") < F.col("observed_at"))
    same = F.lit(True)
    for c in KEY:
        same &= F.col(c) == F.col(f"s_{c}")
    pairs = q.join(s, same & same_instance(F.col("resets_at"), F.col("s_resets_at")) & within)
    oldest = pairs.groupBy(*KEY, "horizon", "used", "observed_at").agg(F.min_by(F.struct("s_used", "s_observed_at"), F.struct("s_observed_at", "s_event_id")).alias("s"))
    elapsed, consumed = minutes_floor(F.col("s.s_observed_at"), F.col("observed_at")), F.col("used") - F.col("s.s_used")
    moved = oldest.select(*KEY, "horizon", elapsed.alias("elapsed"), consumed.alias("consumed"), F.greatest(F.lit(0), 1000 - F.col("used")).alias("left")).filter((F.col("elapsed") >= MIN_HORIZON_MIN) & (F.col("consumed") >= QUANTUM_TENTHS))
    return moved.select(*KEY, "horizon", div(F.col("left") * F.col("elapsed"), F.col("consumed")).alias("runway"))


def window_open_runway() -> Column:
    """From the opening of the window to the reading."""
    elapsed = F.col("window_minutes") - minutes_floor(F.col("observed_at"), F.col("resets_at"))
    return F.when((elapsed > 0) & (F.col("used") >= QUANTUM_TENTHS), div(F.greatest(F.lit(0), 1000 - F.col("used")) * elapsed, F.col("used")))


def pace(quotas: DataFrame, samples: DataFrame, records: DataFrame, now: datetime, offset_minutes: int = 0) -> DataFrame:
    """Will each allowance last until its reset? One row per quota, in order of urgency by (urgency, urgency_value).

    `quotas` are the readings as `projected` has carried them forward, so that a stale one isn't judged as it stands.
    """
    quotas = pooled(quotas)
    trail = trailing_runways(quotas, samples, duty_cycle(records, now, offset_minutes)).groupBy(*KEY).agg(F.min(F.struct("runway", "horizon")).alias("trail"))
    slot = (now - timedelta(minutes=30) + timedelta(minutes=offset_minutes)).hour
    typical = baseline(records, now, offset_minutes).filter(F.col("hour") == slot).select("source_app", F.col("median_tokens").alias("typical"))
    q = quotas.join(trail, KEY, "left").join(burn_rate(records, now), "source_app", "left").join(typical, "source_app", "left")
    q = q.withColumns({"remaining": F.greatest(F.lit(0), 1000 - F.col("used")), "until_reset": minutes_floor(at(now), F.col("resets_at")), "age": minutes_floor(F.col("observed_at"), at(now)), "opened": window_open_runway()})
    aged = F.col("age") > staleness_limit(F.col("window_minutes"))
    since_open = aged | F.col("trail").isNull() | F.coalesce(F.col("opened") <= F.col("trail.runway"), F.lit(False))
    q = q.withColumns({"aged": aged, "basis": F.when(since_open, "window_open").otherwise("trailing"), "basis_minutes": F.when(~since_open, F.col("trail.horizon")), "runway": F.when(since_open, F.col("opened")).otherwise(F.col("trail.runway"))})
    t, runway = F.col("until_reset"), F.col("runway")
    tolerance = F.greatest(div(t, 10), F.col("age"), F.lit(FLOOR_MIN))
    state = (
        F.when(F.col("resets_at").isNull(), "notStarted")
        .when(F.col("remaining") == 0, "exhausted")
        .when(F.col("aged") & (F.coalesce("tokens_per_hour", F.lit(0)) > 0), "unknown")
        .when(runway.isNull(), F.when((F.col("used") == 0) | F.col("aged"), "green").otherwise("unknown"))
        .when(runway > t + tolerance, "green")
        .when(runway < F.greatest(F.lit(0), t - tolerance), "red")
        .otherwise("amber")
    )
    q = q.withColumn("state", state)
    measured = F.col("state").isin("green", "red", "amber") & runway.isNotNull()
    ratio = div(F.coalesce("tokens_per_hour", F.lit(0)) * 100, F.col("typical"))
    q = q.withColumns(
        {
            "runway": F.when(measured, runway),
            "basis": F.when(measured, F.col("basis")),
            "basis_minutes": F.when(measured, F.col("basis_minutes")),
            "slack": F.when(measured & (F.col("state") == "green"), runway - t),
            "shortfall": F.when(measured & (F.col("state") == "red"), t - runway),
            "pace_ratio": F.when(measured, div(t * 100, runway)),
            "vs_baseline": F.when(ratio < 75, "below").when(ratio < 150, "typical").when(ratio < 250, "above").when(ratio.isNotNull(), "farAbove"),
        }
    )
    urgency = F.when(F.col("state") == "red", 0).when(F.col("runway").isNotNull(), 1).otherwise(2)
    return q.select("source_app", "pool", "label", "window_minutes", "used", "remaining", "until_reset", "age", "aged", "state", "runway", "slack", "shortfall", "pace_ratio", "vs_baseline", "basis", "basis_minutes", urgency.alias("urgency"), F.when(urgency < 2, F.col("runway")).alias("urgency_value"))


def ordered_pace(paced: DataFrame) -> DataFrame:
    """Windows that run out first, then by runway, then the rest; ties by window and label."""
    return paced.orderBy("urgency", "urgency_value", "window_minutes", F.col("label").asc_nulls_first())


def binding_windows(quotas: DataFrame, paced: DataFrame) -> DataFrame:
    """The window of each source that binds first: by state, then runway, then what remains of the confirmed reading."""
    rank = F.array_position(F.array(*map(F.lit, ("exhausted", "red", "amber", "unknown", "green", "notStarted"))), F.col("state"))
    confirmed = quotas.select(*KEY, F.greatest(F.lit(0), 1000 - F.col("used")).alias("confirmed_remaining"))
    w = Window.partitionBy("source_app").orderBy(rank, F.col("runway").asc_nulls_last(), "confirmed_remaining", "window_minutes", "pool")
    return paced.join(confirmed, KEY).withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at")


def status_text(binding: DataFrame) -> DataFrame:
    """One line: of each source's binding window what is left, a mark where the pace means trouble, and when it resets."""
    runway = F.col("runway")
    mark = F.when(F.col("state") == "red", F.concat(F.lit("↓"), F.coalesce(compact_duration(runway), F.lit("")))).when(F.col("state") == "amber", "~").when(F.col("state") == "exhausted", "×").otherwise("")
    reset = F.coalesce(F.concat(F.lit("·"), compact_duration(F.col("until_reset"))), F.lit(""))
    tag = F.when(F.col("source_app") == "claude_code", "claude").otherwise(F.col("source_app"))
    text = F.concat(tag, F.lit(" "), round_tenths(F.col("confirmed_remaining")).cast("string"), F.lit("%"), mark, reset)
    rank = F.array_position(F.array(*map(F.lit, reversed(SOURCES))), F.col("source_app"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), text.alias("text")))), lambda x: x.text), " · ")
    return binding.agg(F.coalesce(F.nullif(line, F.lit("")), F.lit("—")).alias("line"))


def tightest_quotas(quotas: DataFrame) -> DataFrame:
    """The allowance of each source with least left; the first by window and label on ties."""
    w = Window.partitionBy("source_app").orderBy(F.greatest(F.lit(0), 1000 - F.col("used")), "window_minutes", "pool")
    return quotas.withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at")


# calibration ---------------------------------------------------------------------------------------------------------
def _scan_spans(batches):
    import pyarrow as pa

    key = anchor = None
    names = [*KEY, "t0", "t1", "moved"]
    for b in batches:
        out = []
        columns = [b.column(c).to_pylist() for c in KEY] + [b.column(c).cast(pa.int64()).to_pylist() for c in ("observed_at", "used", "resets_at")]
        for *own, t, used, reset in zip(*columns, strict=True):
            same = own == key and (reset == anchor[2] or (reset is not None and anchor[2] is not None and abs(reset - anchor[2]) <= INSTANCE_TOLERANCE_US))
            if same and used - anchor[1] < QUANTUM_TENTHS:
                continue
            if same:
                out.append((*own, anchor[0], t, used - anchor[1]))
            key, anchor = own, (t, used, reset)
        types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us"), pa.timestamp("us"), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k in (3, 4) else t).cast(t) for k, t in enumerate(types)], names)


def spans(samples: DataFrame) -> DataFrame:
    """Non-overlapping stretches of at least 20 tenths of movement, by a greedy scan of each window's readings in order.

    A reading of another instance than the anchor's becomes the anchor. The scan carries one anchor along, so a window's
    history isn't bound by memory.
    """
    s = pooled(samples).select("source_app", "pool", F.col("window_minutes").cast("long").alias("window_minutes"), "observed_at", F.col("used").cast("long").alias("used"), "resets_at", "event_id")
    ordered = _dealt(s, *KEY).sortWithinPartitions(*KEY, "observed_at", "event_id")
    return ordered.mapInArrow(_scan_spans, "source_app string, pool string, window_minutes long, t0 timestamp_ntz, t1 timestamp_ntz, moved long")


def span_units(cut: DataFrame, records: DataFrame) -> DataFrame:
    """Cost units of the records in (t0, t1] of each span, as the difference of two running sums; spans without any are left out.

    Records and the ends of spans are sorted together within the minutes of a source, where units run on; what came before a
    minute is a running sum over minutes. So no record is joined with a span, and no task holds more than a minute of a
    source.
    """
    span = F.struct(*KEY, "t0", "t1", "moved")
    ends = cut.select("source_app", F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(-1).alias("sign")), F.struct(F.col("t1").alias("t"), F.lit(1).alias("sign")))).alias("e"), span.alias("span"))
    ends = ends.select("source_app", "e.t", F.lit(0).cast("long").alias("units"), "e.sign", "span")
    spent = records.filter("event_ts is not null").select("source_app", F.col("event_ts").alias("t"), cost_units(F.col("model"), F.col("input"), F.col("output"), F.col("cached_input")).alias("units"))
    both = spent.unionByName(ends, allowMissingColumns=True).withColumn("minute", F.date_trunc("minute", "t"))
    upto = Window.partitionBy("source_app").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = both.groupBy("source_app", "minute").agg(F.sum("units").alias("of_minute")).select("source_app", "minute", F.coalesce(F.sum("of_minute").over(upto), F.lit(0)).alias("before"))
    w = Window.partitionBy("source_app", "minute").orderBy("t", F.col("span").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("run", F.sum("units").over(w)).filter("span is not null").join(minutes, ["source_app", "minute"])
    return run.groupBy("span").agg(F.sum(F.col("sign") * (F.col("before") + F.col("run"))).alias("units")).filter("units > 0").select("span.*", "units")


def calibration(samples: DataFrame, records: DataFrame) -> DataFrame:
    """Allowance moved for each cost unit: the upper median of the spans' rates, and the deviation around it in percent."""
    rated = span_units(spans(samples), records).withColumn("rate", div(F.col("moved") * F.lit(RATE_SCALE) + div(F.col("units"), 2), F.col("units")))
    wide = F.when((F.col("rate") > 0) & (F.col("moved") >= BOOTSTRAP_TENTHS), F.struct("moved", "t0", "rate"))
    fit = rated.groupBy(*KEY).agg(F.sort_array(F.collect_list("rate")).alias("rates"), F.max(wide).alias("widest"))
    median = F.get("rates", div(F.size("rates"), 2).cast("int"))
    apart = F.get(F.sort_array(F.transform("rates", lambda r: F.abs(r - F.col("median")))), div(F.size("rates"), 2).cast("int"))
    fit = fit.withColumn("median", median).withColumn("apart", apart)
    enough = F.size("rates") >= MIN_SPANS
    rate = F.when(enough, F.nullif(F.col("median"), F.lit(0).cast("long"))).otherwise(F.col("widest.rate"))
    n, residual = F.when(enough, F.size("rates")).otherwise(1).cast("long"), F.when(enough, div(F.col("apart") * 100, F.col("median"))).otherwise(0).cast("long")
    return fit.select(*KEY, n.alias("n_spans"), rate.alias("rate"), residual.alias("residual_percent"), (~enough).alias("provisional")).filter("rate is not null")


def projection(quotas: DataFrame, fits: DataFrame, records: DataFrame, now: datetime) -> DataFrame:
    """Readings carried forward by the units spent since, where the fit can be trusted and the reading isn't too old."""
    spent = records.filter("event_ts is not null").select(F.col("source_app").alias("r_source"), F.col("event_ts").alias("t"), cost_units(F.col("model"), F.col("input"), F.col("output"), F.col("cached_input")).alias("units"))
    open_ = quotas.join(fits.filter(F.col("provisional") | (F.col("residual_percent") <= MAX_RESIDUAL)), KEY)
    span = minutes_floor(F.col("observed_at"), at(now))
    open_ = open_.filter((span > 0) & (span <= MAX_PROJECTION_MIN))
    since = spent.filter((F.col("t") <= at(now)) & (F.col("t") > at(now - timedelta(minutes=MAX_PROJECTION_MIN + 1)))).join(open_, (F.col("r_source") == F.col("source_app")) & (F.col("t") > F.col("observed_at")))
    summed = since.groupBy(*KEY, "used", "rate").agg(F.least(F.sum("units"), F.lit(10**18)).cast("decimal(19,0)").alias("units"))
    added = F.least(div(F.col("units") * F.col("rate").cast("decimal(18,0)") + F.lit(RATE_SCALE // 2), F.lit(RATE_SCALE).cast("decimal(13,0)")), F.lit(1000)).cast("long")
    return summed.withColumn("added", added).filter("added > 0").select(*KEY, "used", "added", F.least(F.col("used") + F.col("added"), F.lit(1000)).alias("projected"))


def projected(quotas: DataFrame, projections: DataFrame, now: datetime) -> DataFrame:
    """The quotas with projected readings, seen at `now`, in place of those that have one."""
    ahead = projections.select(*KEY, "projected")
    return quotas.join(ahead, KEY, "left").withColumns({"observed_at": F.when(F.col("projected").isNotNull(), at(now)).otherwise(F.col("observed_at")), "used": F.coalesce("projected", "used")}).drop("projected")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows of a key in one task. They are dealt by a hash of the keys: a repartition by keys that joins or aggregations
    have dealt the rows by already is left out, and adaptive execution, to which a map over batches names no need, may
    then coalesce the sides of a union differently or split a join."""
    return rows.repartition(F.xxhash64(*keys))


def _tile(by: str, now: datetime, minutes: int):
    import numpy as np
    import pyarrow as pa

    end, limit = minutes * 60_000_000, (now - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    def run(batches):
        key, opened, began = None, None, False

        def closed(keys: list, anchors: list, kind) -> pa.RecordBatch:
            ends = [a + end if a is not None and a + end > limit else None for a in anchors]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(ends, pa.int64()).cast(pa.timestamp("us"))], [by, "resets_at"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column, kind = batch.column(by), batch.column(by).type
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
            keys, anchors = [], []
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                name = column[a].as_py()
                if not began or name != key:
                    if began:
                        keys.append(key)
                        anchors.append(opened)
                    key, opened, began = name, None, True
                ts = batch.column("t").slice(a, z - a).drop_null().cast(pa.int64()).to_numpy()
                if opened is None and len(ts):
                    opened = int(ts[0])
                while opened is not None and opened + end <= limit and (k := int(np.searchsorted(ts, opened + end))) < len(ts):
                    opened = int(ts[k])
            if keys:
                yield closed(keys, anchors, kind)
        if began:
            yield closed([key], [opened], kind)

    return run


def tiled_sessions(times: DataFrame, by: str, now: datetime, minutes: int = SESSION_MINUTES, resets: DataFrame | None = None) -> DataFrame:
    """The reset of the fixed-length window that is open at `now`: the first time opens one, the first at or after its end the next.

    Null where the last window has closed and no time has opened another. Each session is read in order of time with
    one window carried along, so its length is not bound by memory. `resets` (by, reset) holds the last resets known:
    times before them belong to windows that have closed. A session with a reset and no time since has no open window.
    """
    rows = times.select(by, F.col("t").cast("timestamp_ntz").alias("t"))
    if resets is not None:
        rows = rows.join(resets.select(by, "reset"), by, "left").filter(F.col("reset").isNull() | (F.col("t") >= F.col("reset"))).select(by, "t")
        rows = rows.unionByName(resets.select(by, F.lit(None).cast("timestamp_ntz").alias("t")))
    shape = f"`{by}` {rows.schema[by].dataType.simpleString()}, resets_at timestamp_ntz"
    return _dealt(rows, by).sortWithinPartitions(by, "t").mapInArrow(_tile(by, now, minutes), shape)


def alerts(quotas: DataFrame, paced: DataFrame, thresholds: DataFrame, snoozed: DataFrame, now: datetime) -> DataFrame:
    """Thresholds that are crossed, one row each, without those snoozed by key. `thresholds`: source_app, metric, limit_value,
    and where they come from `state.limits` enabled and problem: a limit that is off or can't be taken never fires.

    Of each source the window decides that is nearest to the threshold; what is left is that of the confirmed reading.
    """
    if "enabled" in thresholds.columns:
        thresholds = thresholds.filter(F.coalesce("enabled", F.lit(True)) & F.col("problem").isNull()).select("source_app", "metric", "limit_value")
    q = quotas.filter(F.col("resets_at") > at(now)).join(paced.select(*KEY, "state", "shortfall", "until_reset"), KEY)
    q = q.withColumns({"remaining": F.greatest(F.lit(0), 1000 - F.col("used")), "minutes": minutes_ceil(at(now), F.col("resets_at"))})
    j = thresholds.join(q, "source_app")
    metric, limit = F.col("metric"), F.col("limit_value")
    value = F.when(metric == "remaining_percent", F.col("remaining")).when(metric == "minutes_until_reset", micros(F.col("resets_at"))).otherwise(F.coalesce(F.col("until_reset") - F.col("shortfall"), F.lit(1 << 60)))
    one = j.withColumn("at", F.row_number().over(Window.partitionBy("source_app", "metric").orderBy(value, "window_minutes", "pool"))).filter("at = 1")
    crossed = F.when(metric == "remaining_percent", div(F.col("remaining"), 10) <= limit).when(metric == "minutes_until_reset", F.col("minutes") <= limit).otherwise((F.col("state") == "red") & (F.col("shortfall") >= limit))
    key = F.concat_ws(":", "source_app", F.col("window_minutes").cast("string"), named(metric, METRICS), limit.cast("string"), div(micros(F.col("resets_at")), 1_000_000).cast("string"))
    threshold = lambda unit: F.concat(F.lit(" "), window_name(F.col("window_minutes")), F.lit(" · threshold "), limit.cast("string"), F.lit(unit))
    body = (
        F.when(metric == "remaining_percent", F.concat(format_tenths(F.col("remaining")), F.lit(" left"), threshold("%")))
        .when(metric == "minutes_until_reset", F.concat(F.lit("resets in "), F.col("minutes").cast("string"), F.lit(" min"), threshold(" min")))
        .otherwise(F.concat(F.lit("projected to run out "), F.coalesce("shortfall", F.lit(0)).cast("string"), F.lit(" min early"), threshold(" min")))
    )
    title = F.concat(named(F.col("source_app"), SOURCE_TITLES), F.lit(" running low"))
    return one.filter(crossed).select("source_app", "window_minutes", "metric", "limit_value", key.alias("alert_key"), title.alias("title"), body.alias("body")).join(snoozed, "alert_key", "left_anti")


def ordered_alerts(active: DataFrame) -> DataFrame:
    return active.orderBy(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source_app")), "window_minutes")
