"""The registered queries of the usage ledger over the `events` and `conversations` tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scalars as X
from ..operators import conversations, ledger, series, state, views
from ..schema import SOURCES
from ..sources.events_bridge import records, samples
from ..sources.paths import saver, scratch_folder
from ..streaming.ingest import reject_reason
from ..streaming.ledger import Ledger, Scope

NOW = datetime(2024, 1, 31)
AS_OF = datetime(2024, 1, 20, 15)
SEEN = AS_OF - timedelta(minutes=45)
WANTED = ledger.Filter(sources=("cursor", "codex"), models=("opus-1", "sonnet-1"), since=datetime(2024, 1, 5), until=datetime(2024, 1, 20))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def totals(spark, sf_dir):
    return ledger.totals(records(spark, sf_dir))


@query
def totals_by_source(spark, sf_dir):
    return ledger.totals(records(spark, sf_dir), "source_app")


@query
def totals_by_model(spark, sf_dir):
    return ledger.totals(records(spark, sf_dir), "model").withColumn("label", F.coalesce("model", F.lit("Unknown model")))


@query
def totals_grouping_sets(spark, sf_dir):
    return ledger.totals_all_levels(records(spark, sf_dir))


@query
def cost_by_currency(spark, sf_dir):
    return ledger.cost_by_currency(records(spark, sf_dir))


@query
def filtered_summary(spark, sf_dir):
    return ledger.totals(WANTED.apply(records(spark, sf_dir)), "source_app", "model")


@query
def undated_excluded(spark, sf_dir):
    return ledger.undated_excluded(records(spark, sf_dir), WANTED)


@query
def recent_50(spark, sf_dir):
    return ledger.recent(records(spark, sf_dir)).select("event_id", "source_app", "model", "event_ts", "display")


@query
def threads_top(spark, sf_dir):
    return ledger.top_threads(records(spark, sf_dir), 100).select("source_app", "session_id", "records", "display", "models", "first_event", "last_event", "project")


@query
def threads_header(spark, sf_dir):
    return ledger.threads_header(records(spark, sf_dir))


@query
def share_of_total(spark, sf_dir):
    return ledger.share_of_total(records(spark, sf_dir), "model")


@query
def dedupe_keys(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", "dedupe_key", X.record_id(F.col("source_app"), F.col("dedupe_key")).alias("record_id"))


@query
def content_hash(spark, sf_dir):
    """The bridge's instant is its source's timestamp; a count is exact where known; reported cost has no pricing version."""
    instant, none = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(None).cast("string")
    counts = [(F.col(c), F.when(F.col(c).isNotNull(), "exact").otherwise("unknown")) for c in ("input", "output", "cached_input", "reasoning")]
    status = F.when(F.col("amount_minor").isNotNull(), "reported_by_source")
    of = X.content_hash(instant, X.provider_of(F.col("model")), F.col("model"), counts, F.col("reported"), F.col("project"), F.col("session_id"), (status, none, F.col("amount_minor"), F.col("currency"), F.col("exponent")))
    return records(spark, sf_dir).select("event_id", of.alias("content_hash"))


@query
def group_lists(spark, sf_dir):
    """Totals by model with their span, in list order, as a list shows them."""
    r = records(spark, sf_dir)
    label = F.coalesce("model", F.lit("Unknown model"))
    groups = ledger.totals(r, "model").join(ledger.date_span(r, "model").withColumnRenamed("model", "of"), F.col("model").eqNullSafe(F.col("of")))
    shown = groups.select(label.alias("label"), "display", X.group_digits(F.col("display")).alias("tokens"), state.partial_total(F.col("display_unknown")).alias("partial"), "first_event", "last_event")
    return ledger.ordered_groups(shown, "label")


@query
def cost_display(spark, sf_dir):
    """Each cost in two decimals, and the threads' names."""
    r = records(spark, sf_dir)
    return r.select("event_id", X.format_money(F.col("amount_minor"), F.col("exponent"), F.col("currency")).alias("cost"), X.thread_name(F.col("project"), F.col("session_id")).alias("thread"))


@query
def last_days(spark, sf_dir):
    """The default view of one source: its last thirty days."""
    return ledger.totals(ledger.last_days(NOW, source="codex").apply(records(spark, sf_dir)), "model")


@query
def display_total_rules(spark, sf_dir):
    rule = X.total_rule(*map(F.col, ("reported", "input", "output", "reasoning")))
    return records(spark, sf_dir).groupBy(rule.alias("rule")).agg(F.count("*").alias("n"), F.coalesce(F.sum("display"), F.lit(0)).alias("tokens"))


@query
def timestamp_interpretation(spark, sf_dir):
    """The bridge's instants written in nine ways, and read back."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 9
    raw = (
        F.when(k == 0, F.unix_seconds(t).cast("string"))
        .when(k == 1, F.unix_micros(t).cast("string"))
        .when(k == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 3, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 4, F.lit("not a time"))
        .when(k == 5, F.lit("  "))
        .when(k == 6, F.date_format(t, "yyyy-MM-dd HH:mm"))
        .when(k == 7, F.date_format(t, "yyyy-MM-dd'T'HH:mm"))
        .otherwise(F.concat(F.lit("-"), F.unix_seconds(t).cast("string")))
    )
    r = records(spark, sf_dir).select("event_id", "ts", raw.alias("raw"))
    return r.select("event_id", X.timestamp_kind(F.col("raw")).alias("kind"), X.parse_timestamp(F.col("raw")).cast("timestamp_ntz").alias("parsed"))


def _store(r: DataFrame) -> DataFrame:
    """All records before the middle of the month."""
    return r.filter(F.col("ts") < series.at(datetime(2024, 1, 16))).select("dedupe_key", "source_app", "event_ts", X.joined_hash(F.col("display")).alias("content_hash"))


def _batch(r: DataFrame) -> DataFrame:
    """All records, a sixth of them changed, and every tenth once more."""
    changed = F.when(F.col("event_id") % 6 == 4, F.col("display") + 1).otherwise(F.col("display"))
    rows = r.select("dedupe_key", "source_app", "event_ts", X.joined_hash(changed).alias("content_hash"), F.col("event_id").alias("seq"))
    again = r.filter("event_id % 10 = 0").select("dedupe_key", "source_app", "event_ts", X.joined_hash(F.col("display") + 1).alias("content_hash"), (F.col("event_id") + 1_000_000_000).alias("seq"))
    return rows.unionByName(again)


@query
def merge_classify(spark, sf_dir):
    r = records(spark, sf_dir)
    return ledger.classify(_batch(r), _store(r)).groupBy("outcome").agg(F.count("*").alias("n"))


@query
def merge_result(spark, sf_dir):
    r = records(spark, sf_dir)
    return ledger.merged(_batch(r), _store(r)).select("dedupe_key", "content_hash")


@query
def change_rows(spark, sf_dir):
    r = records(spark, sf_dir)
    return state.change_rows(ledger.classify(_batch(r), _store(r)))


@query
def rejected_drafts(spark, sf_dir):
    """The bridge's records as drafts, some of them broken in one of five ways."""
    e, none = F.col("event_id") % 16, F.lit(None).cast("string")
    cost = F.col("amount_minor").isNotNull()
    drafts = records(spark, sf_dir).select(
        F.when(e != 1, F.col("source_app")).alias("source_app"), F.when(e == 2, -F.col("input")).otherwise(F.col("input")).alias("input"), "output", "cached_input", "reasoning", F.col("reported").alias("reported_total"),
        F.when(e == 3, "unknown").alias("input_quality"), F.when(e == 4, "exact").alias("output_quality"), none.alias("cached_input_quality"), none.alias("reasoning_quality"),
        F.when(cost, F.when(e == 5, "computed_from_pricing").when(e == 6, "not_available").otherwise("reported_by_source")).alias("cost_status"), F.when(e == 5, " ").alias("pricing_version"), "amount_minor",
        F.when(e == 7, "US").otherwise(F.col("currency")).alias("currency"), F.when(e == 8, 7).otherwise(F.col("exponent")).alias("exponent"),
    )
    return drafts.groupBy(reject_reason().alias("reason")).agg(F.count("*").alias("n"))


@query
def quota_merge(spark, sf_dir):
    """Readings up to a day before, merged with those of the last source and its replaced windows."""
    s = samples(records(spark, sf_dir), True).drop("event_id")
    newest = lambda until: s.filter(F.col("observed_at") <= series.at(until)).groupBy("source_app", "label", "window_minutes").agg(*(F.max_by(c, "observed_at").alias(c) for c in ("used", "resets_at", "observed_at")))
    later = newest(SEEN).filter("label is null or label = 'Small models'")
    return state.merged_quotas(newest(SEEN - timedelta(days=1)), later, source="cursor").select("source_app", "label", "used", "resets_at", "observed_at")


@query
def health_states(spark, sf_dir):
    """Every event as an attempt to read its source."""
    k = F.col("event_id") % 7
    outcome = F.when(k.isin(0, 4), "started").when(k.isin(1, 5), "succeeded").when(k == 2, "offline").otherwise("failed")
    attempts = records(spark, sf_dir).select("source_app", F.col("event_id").alias("seq"), F.col("ts").alias("at"), outcome.alias("outcome"), F.when(k == 5, F.col("event_ts")).alias("observed_at"), (k == 5).alias("awaiting"), F.concat(F.lit("error "), k.cast("string")).alias("error"))
    return state.health_history(attempts)


@query
def placeholders_retired(spark, sf_dir):
    """Undated models stand for live rows here: those the dated feed of their source has passed go."""
    r = records(spark, sf_dir).withColumn("source_ref", F.when(F.col("model").isNull(), "local-activity").otherwise("dashboard-window"))
    return state.without_placeholders(r).groupBy("source_app", "source_ref").agg(F.count("*").alias("n"))


@query
def replace_scope_delete(spark, sf_dir):
    r = records(spark, sf_dir)
    return ledger.outside_scope(_store(r), r.filter(F.col("display") > 20_000), "codex", datetime(2024, 1, 10), datetime(2024, 1, 15)).select("dedupe_key")


def _committed(spark, sf_dir) -> Ledger:
    """A ledger after three commits: all records before the middle of the month; all of them, a sixth changed and every
    tenth once more; the large ones as they were, which is all that the source reports of five days."""
    r = records(spark, sf_dir)

    def drafts(rows, display, position):
        value = display.alias("display")
        return rows.select(*(c for c in rows.columns if c != "display"), value, X.joined_hash(display).alias("content_hash"), position.alias("position"), F.lit("bridge").alias("adapter"), F.lit(None).cast("string").alias("reject_reason"))

    plain, place = F.col("display"), F.col("event_id")
    changed = drafts(r, F.when(place % 6 == 4, plain + 1).otherwise(plain), place).unionByName(drafts(r.filter("event_id % 10 = 0"), plain + 1, place + 1_000_000_000))
    out = Ledger(spark, scratch_folder(spark, "ledger"))
    out.commit(drafts(r.filter(F.col("ts") < series.at(datetime(2024, 1, 16))), plain, place), 1)
    out.commit(changed, 2)
    out.commit(drafts(r.filter("display > 20000"), plain, place), 3, scopes=[Scope("codex", datetime(2024, 1, 15), datetime(2024, 1, 10), "bridge")])
    return out


@query
def ledger_after_commits(spark, sf_dir):
    """The records that stand after three commits, and the commit that each is of."""
    return _committed(spark, sf_dir).current(columns=("dedupe_key", "content_hash", "revision"))


@query
def ledger_folded_totals(spark, sf_dir):
    """Totals after three commits, folded from what each has added and taken away; no record is read for them."""
    return _committed(spark, sf_dir).at().totals("source_app", "model")


@query
def ledger_folded_costs(spark, sf_dir):
    return _committed(spark, sf_dir).at().costs("source_app")


@query
def ledger_published(spark, sf_dir):
    """What each of three commits has published of each source."""
    return _committed(spark, sf_dir).changes().select("commit", "revision", "source_app", "inserted", "updated", "deleted", "unchanged")


@query
def quota_samples_change_only(spark, sf_dir):
    return samples(records(spark, sf_dir)).select("source_app", "used", "resets_at", "observed_at")


def _live(spark, sf_dir, pools=True):
    return series.live_quotas(samples(records(spark, sf_dir), pools), SEEN, AS_OF)


def _narrow(spark, sf_dir, save) -> DataFrame:
    """All records, read once and written with the columns from which readings and history are made."""
    return save(records(spark, sf_dir).select("source_app", "model", "ts", "event_id", "event_ts", "input", "output", "cached_input", "display"), "records")


def _risk(spark, sf_dir) -> views.Risk:
    save = saver(spark, "risk")
    r = _narrow(spark, sf_dir, save)
    return views.risk(samples(r, True), r, SEEN, AS_OF, save)


def _calibrating(spark, sf_dir):
    """Readings and history, both written."""
    save = saver(spark, "fit")
    r = _narrow(spark, sf_dir, save)
    return save(samples(r, True).filter(F.col("observed_at") <= series.at(SEEN)), "samples"), r.filter(F.col("event_ts") <= series.at(AS_OF))


@query
def quota_latest(spark, sf_dir):
    return _live(spark, sf_dir, pools=False).select("source_app", "used", "resets_at", "observed_at")


@query
def quota_pools(spark, sf_dir):
    """The newest reading of each allowance, and which is the tightest of its source."""
    quotas = _live(spark, sf_dir)
    tightest = series.tightest_quotas(quotas).select(*series.KEY, F.lit(True).alias("tightest"))
    return quotas.join(tightest, series.KEY, "left").select("source_app", "label", "used", "resets_at", "observed_at", F.coalesce("tightest", F.lit(False)).alias("tightest"))


@query
def baseline_median_hour(spark, sf_dir):
    return series.baseline(records(spark, sf_dir), NOW)


@query
def duty_cycle(spark, sf_dir):
    return series.duty_cycle(records(spark, sf_dir), NOW)


@query
def burn_rate(spark, sf_dir):
    return series.burn_rate(records(spark, sf_dir), AS_OF)


@query
def pace_states(spark, sf_dir):
    return _risk(spark, sf_dir).paced.drop("pool")


@query
def binding_window(spark, sf_dir):
    risk = _risk(spark, sf_dir)
    return series.binding_windows(risk.quotas, risk.paced).select("source_app", "label", "window_minutes", "state", "confirmed_remaining", "runway")


@query
def status_line(spark, sf_dir):
    risk = _risk(spark, sf_dir)
    return series.status_text(series.binding_windows(risk.quotas, risk.paced))


@query
def calibration_spans(spark, sf_dir):
    seen, history = _calibrating(spark, sf_dir)
    return series.span_units(series.spans(seen), history)


@query
def calibration_fit(spark, sf_dir):
    return series.calibration(*_calibrating(spark, sf_dir))


@query
def projection(spark, sf_dir):
    seen, history = _calibrating(spark, sf_dir)
    return series.projection(series.live_quotas(seen, SEEN, AS_OF), series.calibration(seen, history), history, AS_OF)


LIMITS = (("remaining_percent", 45), ("minutes_until_reset", 600), ("projected_exhaustion", 60))
SNOOZED = "cursor:1440:MinutesUntilReset:600:1705795200"


@query
def alerts_active(spark, sf_dir):
    thresholds = spark.createDataFrame([(s, m, v) for s in SOURCES for m, v in LIMITS], "source_app string, metric string, limit_value long")
    risk = _risk(spark, sf_dir)
    return series.alerts(risk.quotas, risk.paced, thresholds, spark.createDataFrame([(SNOOZED,)], "alert_key string"), AS_OF)


@query
def alert_board(spark, sf_dir):
    """Alerts in their order, and which of them are new: fired ones whose window still runs don't fire again."""
    thresholds = spark.createDataFrame([(s, m, v) for s in SOURCES for m, v in LIMITS], "source_app string, metric string, limit_value long")
    risk, none = _risk(spark, sf_dir), spark.createDataFrame([], "alert_key string")
    active = series.alerts(risk.quotas, risk.paced, thresholds, none, AS_OF)
    fired = state.live_keys(spark.createDataFrame([(SNOOZED,), ("cursor:1440:MinutesUntilReset:600:1705708800",)], "alert_key string"), active)
    new = state.to_fire(active, fired).select("alert_key", F.lit(True).alias("fires"))
    board = series.ordered_alerts(active).join(new, "alert_key", "left").withColumn("fires", F.coalesce("fires", F.lit(False)))
    return board.select("source_app", "window_minutes", "metric", "alert_key", "fires")


@query
def alerts_by_options(spark, sf_dir):
    """Alerts of the limits that options leave: the last option of a source, if it is on and can be taken, else none."""
    risk, none = _risk(spark, sf_dir), spark.createDataFrame([], "alert_key string")
    on = spark.createDataFrame([(1, "codex", "minutes_until_reset", 600, True), (2, "cursor", "minutes_until_reset", 600, False), (3, "claude_code", "remaining_percent", 101, True)], "seq long, source_app string, metric string, limit_value long, enabled boolean")
    return series.alerts(risk.quotas, risk.paced, state.limits(on), none, AS_OF)


def _placed(ordered: DataFrame) -> DataFrame:
    """A short list with the place of each row, which its order alone doesn't tell."""
    rows = [(k, *r) for k, r in enumerate(ordered.limit(ledger.LIMIT_MAX).collect())]
    return ordered.sparkSession.createDataFrame(rows, StructType([StructField("place", LongType()), *ordered.schema.fields]))


@query
def pace_order(spark, sf_dir):
    """Paces in the order of a list, by place."""
    ordered = series.ordered_pace(_risk(spark, sf_dir).paced).select("source_app", "label", "state", "runway")
    return _placed(ordered)


@query
def menu_rows(spark, sf_dir):
    return views.menu_rows(_live(spark, sf_dir), records(spark, sf_dir))


@query
def quota_groups(spark, sf_dir):
    """Allowances as a list reads them: sources in their fixed order, shorter windows first."""
    return _placed(views.in_reading_order(_live(spark, sf_dir).select("source_app", "pool", "window_minutes", "used")))


@query
def awaiting_billing(spark, sf_dir):
    """Whether a source's activity is newer than all that was published of it, here the records with a project."""
    r = records(spark, sf_dir)
    each = lambda s: state.awaiting_upstream(r.filter(F.col("source_app") == s), r.filter((F.col("source_app") == s) & F.col("project").isNotNull())).withColumn("source_app", F.lit(s))
    return reduce(DataFrame.unionByName, map(each, SOURCES))


@query
def limit_options(spark, sf_dir):
    """Every event of two sources as a setting of its limit; the third source keeps the default."""
    r, k = records(spark, sf_dir), F.col("event_id") % 3
    metric = F.when(k == 0, "remaining_percent").when(k == 1, "minutes_until_reset").otherwise("projected_exhaustion")
    return state.limits(r.filter("source_app <> 'cursor'").select(F.col("event_id").alias("seq"), "source_app", metric.alias("metric"), F.col("input").alias("limit_value"), (F.col("event_id") % 2 == 0).alias("enabled")))


@query
def session_tiling(spark, sf_dir):
    times = records(spark, sf_dir).filter(F.col("event_ts") <= series.at(AS_OF)).filter("session_id is not null")
    return series.tiled_sessions(times.select("session_id", F.col("event_ts").alias("t")), "session_id", AS_OF)


@query
def session_tiling_from_resets(spark, sf_dir):
    """Sessions tiled from the end of a window known to have closed, half a day after each began; some have no time since."""
    times = records(spark, sf_dir).filter(F.col("event_ts") <= series.at(AS_OF)).filter("session_id is not null").select("session_id", F.col("event_ts").alias("t"))
    resets = times.groupBy("session_id").agg((F.min("t") + F.expr("INTERVAL 12 HOURS")).alias("reset"))
    return series.tiled_sessions(times, "session_id", AS_OF, resets=resets)


@query
def source_strip(spark, sf_dir):
    return views.source_strip(records(spark, sf_dir), _live(spark, sf_dir))


@query
def model_rows(spark, sf_dir):
    return views.model_rows(records(spark, sf_dir))


@query
def thread_list(spark, sf_dir):
    return views.thread_list(records(spark, sf_dir))


@query
def stat_bar(spark, sf_dir):
    return views.stat_bar(WANTED.apply(records(spark, sf_dir)))


@query
def quota_rows(spark, sf_dir):
    """Every allowance as a row of the screen, from confirmed reading, projection and pace."""
    risk = _risk(spark, sf_dir)
    return views.quota_rows(risk.quotas, risk.projections, risk.fits, risk.paced, AS_OF)


@query
def event_details(spark, sf_dir):
    kind, priced = F.when(F.col("event_ts").isNull(), "missing").otherwise("explicit_offset"), F.col("amount_minor").isNotNull()
    known = {"timestamp_interpretation": kind, "cost_status": F.when(priced, F.when(F.col("currency") == "EUR", "computed_from_pricing").otherwise("reported_by_source")), "pricing_version": F.when(F.col("event_id") % 2 == 0, "v7"), "input_quality": F.when(F.col("input").isNotNull() & (F.col("event_id") % 3 == 0), "estimated"), "output_quality": F.when(F.col("output").isNotNull() & (F.col("event_id") % 3 == 1), "partial")}
    return views.event_details(records(spark, sf_dir).withColumns(known))


@query
def health_rows(spark, sf_dir):
    """The health that every source is left in."""
    return views.health_rows(health_states(spark, sf_dir), spark.createDataFrame([(s, s == SOURCES[0]) for s in SOURCES], "source_app string, needs_network boolean"), NOW)


@query
def hourly_tumbling(spark, sf_dir):
    r = records(spark, sf_dir).filter("event_ts is not null")
    return r.groupBy("source_app", F.window("event_ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.coalesce(F.sum("display"), F.lit(0)).alias("tokens")).select("source_app", F.col("w.start").alias("hour_start"), "n", "tokens")


@query
def conversation_turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    user, size = F.col("role") == "user", F.length("text")
    b = c.select(F.col("conv_id").alias("conversation"), F.col("turn").alias("at"), F.concat_ws(":", "role", F.sha2("text", 256)).alias("bubble"), F.coalesce(user, F.lit(False)).alias("is_user"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("m"), (F.col("conv_id") % 4).cast("string"))).alias("model"), F.when(~user & (size % 3 != 0), size.cast("long")).otherwise(0).alias("tokens"))
    return conversations.turn_drafts(b)


_RECORDS = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c FROM events),
r0 AS (SELECT event_id, ts,
  CASE user_id % 3 WHEN 0 THEN 'cursor' WHEN 1 THEN 'claude_code' ELSE 'codex' END AS source_app,
  CASE WHEN event_type = 'signup' THEN NULL ELSE concat('s', CAST(user_id AS VARCHAR)) END AS session_id,
  CASE WHEN k % 7 = 0 THEN NULL ELSE concat('p', CAST(k % 6 AS VARCHAR)) END AS project,
  CASE event_type WHEN 'click' THEN 'haiku-1' WHEN 'view' THEN 'sonnet-1' WHEN 'purchase' THEN 'opus-1' WHEN 'signup' THEN 'o4-mini' END AS model,
  CASE WHEN event_type = 'error' THEN NULL ELSE c END AS input,
  CASE WHEN event_type = 'error' THEN NULL ELSE k END AS output,
  CASE WHEN k % 4 = 0 THEN NULL ELSE c * 3 END AS cached_input,
  CASE WHEN user_id % 3 = 2 THEN k * 2 END AS reasoning,
  CASE WHEN k % 10 = 0 THEN c + k + 7 END AS reported,
  CASE WHEN event_type = 'purchase' THEN c * 100 WHEN event_type = 'view' AND k % 5 IN (0, 1) THEN c END AS amount_minor,
  CASE WHEN event_type = 'purchase' OR (event_type = 'view' AND k % 5 = 1) THEN 'USD' WHEN event_type = 'view' AND k % 5 = 0 THEN 'EUR' END AS currency,
  CASE WHEN event_type = 'purchase' THEN 4 WHEN event_type = 'view' AND k % 5 IN (0, 1) THEN 2 END AS exponent,
  CASE WHEN k % 50 = 0 THEN NULL ELSE ts END AS event_ts FROM e),
r AS (SELECT *, coalesce(reported, CASE WHEN input IS NOT NULL OR output IS NOT NULL THEN coalesce(input, 0) + coalesce(output, 0) + coalesce(reasoning, 0) END) AS display,
  sha256('v1' || chr(31) || source_app || chr(31) || 'event' || chr(31) || 'e' || CAST(event_id AS VARCHAR)) AS dedupe_key,
  CASE WHEN model LIKE '%opus%' THEN coalesce(input, 0) * 1500 + coalesce(output, 0) * 7500 + coalesce(cached_input, 0) * 30
       WHEN model LIKE '%haiku%' THEN coalesce(input, 0) * 100 + coalesce(output, 0) * 500 + coalesce(cached_input, 0) * 2
       ELSE coalesce(input, 0) * 300 + coalesce(output, 0) * 1500 + coalesce(cached_input, 0) * 6 END AS units FROM r0)
"""
_SAMPLES = (
    _RECORDS
    + """, m AS (SELECT *, CAST(ts AS DATE) AS d, 1000 * sum(units) OVER (PARTITION BY source_app, CAST(ts AS DATE) ORDER BY ts, event_id) // nullif(sum(units) OVER (PARTITION BY source_app, CAST(ts AS DATE)), 0) AS u FROM r),
  m2 AS (SELECT *, CAST(coalesce(u, 0) AS BIGINT) AS used, lag(coalesce(u, 0)) OVER (PARTITION BY source_app, d ORDER BY ts, event_id) AS before FROM m),
  s AS (SELECT source_app, used, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS resets_at, ts AS observed_at, event_id FROM m2 WHERE before IS NULL OR before <> used),
  live AS (SELECT source_app, used, resets_at, observed_at FROM s WHERE observed_at <= TIMESTAMP '2024-01-20 14:15:00' AND TRUE QUALIFY row_number() OVER (PARTITION BY source_app ORDER BY observed_at DESC, event_id DESC) = 1)
"""
)


#: Allowances with pools, and everything that pace is made of, step by step.
_PACE = (
    _RECORDS.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
    + """, p AS (SELECT *, CAST(ts AS DATE) AS d, CASE WHEN source_app <> 'cursor' THEN '' WHEN model IN ('haiku-1', 'o4-mini') THEN 'Small models' ELSE 'Other models' END AS pool FROM r),
  m AS (SELECT *, CAST(coalesce(1000 * sum(units) OVER (PARTITION BY source_app, pool, d ORDER BY ts, event_id) // nullif(sum(units) OVER (PARTITION BY source_app, pool, d), 0), 0) AS BIGINT) AS used FROM p),
  m2 AS (SELECT *, lag(used) OVER (PARTITION BY source_app, pool, d ORDER BY ts, event_id) AS before FROM m),
  s AS (SELECT source_app, pool, used, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS resets_at, ts AS observed_at, event_id FROM m2 WHERE (before IS NULL OR before <> used) AND ts <= TIMESTAMP '2024-01-20 14:15:00'),
  quotas AS (SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source_app, pool ORDER BY observed_at DESC, event_id DESC) = 1) WHERE resets_at > TIMESTAMP '2024-01-20 15:00:00'),
  history AS (SELECT * FROM r WHERE event_ts <= TIMESTAMP '2024-01-20 15:00:00'),
  nth AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_app, pool ORDER BY observed_at, event_id) AS i FROM s),
  scan AS (SELECT source_app, pool, i, observed_at AS a_at, used AS a_used, resets_at AS a_reset, CAST(NULL AS TIMESTAMP) AS t0, CAST(NULL AS TIMESTAMP) AS t1, CAST(NULL AS BIGINT) AS moved FROM nth WHERE i = 1
    UNION ALL SELECT n.source_app, n.pool, n.i, CASE WHEN same AND step < 20 THEN a_at ELSE n.observed_at END, CASE WHEN same AND step < 20 THEN a_used ELSE n.used END, CASE WHEN same AND step < 20 THEN a_reset ELSE n.resets_at END,
      CASE WHEN same AND step >= 20 THEN a_at END, CASE WHEN same AND step >= 20 THEN n.observed_at END, CASE WHEN same AND step >= 20 THEN step END
      FROM (SELECT n.*, c.a_at, c.a_used, c.a_reset, abs(epoch_us(c.a_reset) - epoch_us(n.resets_at)) <= 120000000 AS same, greatest(0, n.used - c.a_used) AS step FROM scan c JOIN nth n ON n.source_app = c.source_app AND n.pool = c.pool AND n.i = c.i + 1) n),
  spans AS (SELECT c.source_app, c.pool, 1440 AS window_minutes, c.t0, c.t1, c.moved, CAST(sum(h.units) AS BIGINT) AS units FROM scan c JOIN history h ON h.source_app = c.source_app AND h.event_ts > c.t0 AND h.event_ts <= c.t1 WHERE c.t0 IS NOT NULL GROUP BY ALL HAVING sum(h.units) > 0),
  rated AS (SELECT *, (moved * 1000000000000 + units // 2) // units AS rate FROM spans),
  lists AS (SELECT source_app, pool, list_sort(list(rate)) AS rates, count(*) AS n, max({'moved': moved, 't0': t0, 'rate': rate}) FILTER (rate > 0 AND moved >= 50) AS widest FROM rated GROUP BY source_app, pool),
  middle AS (SELECT *, rates[n // 2 + 1] AS median FROM lists),
  fit AS (SELECT source_app, pool, 1440 AS window_minutes, CAST(CASE WHEN n >= 3 THEN n ELSE 1 END AS BIGINT) AS n_spans, CAST(CASE WHEN n >= 3 THEN nullif(median, 0) ELSE widest.rate END AS BIGINT) AS rate,
      CAST(CASE WHEN n >= 3 THEN list_sort(list_transform(rates, lambda x: abs(x - median)))[n // 2 + 1] * 100 // nullif(median, 0) ELSE 0 END AS BIGINT) AS residual_percent, n < 3 AS provisional FROM middle),
  spent AS (SELECT q.source_app, q.pool, q.used, f.rate, least(sum(h.units), 1000000000000000000) AS units FROM quotas q JOIN fit f USING (source_app, pool) JOIN history h ON h.source_app = q.source_app AND h.event_ts > q.observed_at
      WHERE f.rate IS NOT NULL AND (f.provisional OR f.residual_percent <= 35) AND (epoch_us(TIMESTAMP '2024-01-20 15:00:00') - epoch_us(q.observed_at)) // 60000000 BETWEEN 1 AND 120 GROUP BY ALL),
  ahead AS (SELECT source_app, pool, 1440 AS window_minutes, used, CAST(least((CAST(units AS HUGEINT) * rate + 500000000000) // 1000000000000, 1000) AS BIGINT) AS added FROM spent),
  projection AS (SELECT *, least(1000, used + added) AS projected FROM ahead WHERE added > 0),
  q0 AS (SELECT q.source_app, q.pool, coalesce(p.projected, q.used) AS used, q.used AS confirmed, q.resets_at, CASE WHEN p.projected IS NULL THEN q.observed_at ELSE TIMESTAMP '2024-01-20 15:00:00' END AS observed_at FROM quotas q LEFT JOIN projection p USING (source_app, pool)),
  cell AS (SELECT source_app, CAST(event_ts AS DATE) AS d, hour(event_ts) AS h, sum(display) AS t FROM history WHERE event_ts >= TIMESTAMP '2023-12-21 15:00:00' AND display IS NOT NULL GROUP BY ALL),
  typical AS (SELECT source_app, CASE WHEN count(*) >= 3 THEN list_sort(list(t))[(count(*) - 1) // 2 + 1] END AS typical FROM cell WHERE h = 14 GROUP BY source_app),
  burn AS (SELECT source_app, sum(display) * 60 // 60 AS rate FROM history WHERE event_ts >= TIMESTAMP '2024-01-20 14:00:00' AND display IS NOT NULL GROUP BY source_app),
  tried AS (SELECT q.source_app, q.pool, q.used, q.observed_at, g.h, min_by({'u': s.used, 't': s.observed_at}, {'t': s.observed_at, 'i': s.event_id}) AS o FROM q0 q CROSS JOIN (VALUES (CAST(30 AS BIGINT)), (144), (360)) AS g(h)
      JOIN s ON s.source_app = q.source_app AND s.pool = q.pool AND abs(epoch_us(s.resets_at) - epoch_us(q.resets_at)) <= 120000000 AND epoch_us(s.observed_at) >= epoch_us(q.observed_at) - g.h * 60000000 AND s.observed_at < q.observed_at GROUP BY ALL),
  trail AS (SELECT source_app, pool, best, best.runway AS trail FROM (SELECT source_app, pool, min({'runway': (1000 - used) * ((epoch_us(observed_at) - epoch_us(o.t)) // 60000000) // (used - o.u), 'h': h}) AS best FROM tried WHERE (epoch_us(observed_at) - epoch_us(o.t)) // 60000000 >= 10 AND used - o.u >= 20 GROUP BY source_app, pool)),
  q1 AS (SELECT q0.*, trail, best.h AS horizon, burn.rate AS burning, typical, greatest(0, 1000 - used) AS remaining, greatest(0, (epoch_us(resets_at) - epoch_us(TIMESTAMP '2024-01-20 15:00:00')) // 60000000) AS left_min,
      greatest(0, (epoch_us(TIMESTAMP '2024-01-20 15:00:00') - epoch_us(observed_at)) // 60000000) AS age, 1440 - greatest(0, (epoch_us(resets_at) - epoch_us(observed_at)) // 60000000) AS gone
      FROM q0 LEFT JOIN trail USING (source_app, pool) LEFT JOIN burn USING (source_app) LEFT JOIN typical USING (source_app)),
  q2 AS (SELECT *, age > 144 AS aged, CASE WHEN gone > 0 AND used >= 20 THEN remaining * gone // used END AS opened, greatest(left_min // 10, age, 15) AS tolerance FROM q1),
  q3 AS (SELECT *, CASE WHEN aged THEN opened ELSE least(coalesce(opened, trail), coalesce(trail, opened)) END AS run FROM q2),
  q4 AS (SELECT *, CASE WHEN remaining = 0 THEN 'exhausted' WHEN aged AND coalesce(burning, 0) > 0 THEN 'unknown' WHEN run IS NULL THEN CASE WHEN used = 0 OR aged THEN 'green' ELSE 'unknown' END
      WHEN run > left_min + tolerance THEN 'green' WHEN run < greatest(0, left_min - tolerance) THEN 'red' ELSE 'amber' END AS state, coalesce(burning, 0) * 100 // nullif(typical, 0) AS ratio FROM q3),
  pace AS (SELECT *, CASE WHEN state IN ('green', 'red', 'amber') THEN run END AS runway, CASE WHEN state IN ('green', 'red', 'amber') AND run IS NOT NULL THEN CASE WHEN aged OR trail IS NULL OR coalesce(opened <= trail, FALSE) THEN 'window_open' ELSE 'trailing' END END AS basis FROM q4),
  b AS (SELECT *, greatest(0, 1000 - confirmed) AS confirmed_remaining FROM pace QUALIFY row_number() OVER (PARTITION BY source_app ORDER BY list_position(['exhausted', 'red', 'amber', 'unknown', 'green', 'notStarted'], state), runway NULLS LAST, greatest(0, 1000 - confirmed), pool) = 1)
"""
)
_SHORT = "CASE WHEN {0} < 60 THEN concat({0}, 'm') WHEN {0} < 2880 THEN concat(({0} + 30) // 60, 'h') ELSE concat(({0} + 720) // 1440, 'd') END"


def _totals_sql() -> str:
    out = ["count(*) AS records"]
    for c in ledger.COUNTS:
        out += [f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}", f"count({c}) AS {c}_counted", f"count(*) - count({c}) AS {c}_unknown"]
    return ", ".join([*out, "count(*) - count(amount_minor) AS records_without_cost"])


_T = _totals_sql()
_HASH = "sha256(coalesce(CAST({} AS VARCHAR), ''))"
_MERGE = (
    _RECORDS
    + f""", store AS (SELECT dedupe_key, source_app, event_ts, {_HASH.format("display")} AS h FROM r WHERE ts < TIMESTAMP '2024-01-16'),
  batch AS (SELECT dedupe_key, {_HASH.format("CASE WHEN event_id % 6 = 4 THEN display + 1 ELSE display END")} AS h, event_id AS seq, source_app FROM r
    UNION ALL SELECT dedupe_key, {_HASH.format("display + 1")}, event_id + 1000000000, source_app FROM r WHERE event_id % 10 = 0),
  c AS (SELECT b.*, coalesce(lag(b.h) OVER (PARTITION BY b.dedupe_key ORDER BY b.seq), s.h) AS before FROM batch b LEFT JOIN store s USING (dedupe_key)),
  o AS (SELECT *, CASE WHEN before IS NULL THEN 'inserted' WHEN before = h THEN 'unchanged' ELSE 'updated' END AS outcome FROM c)
"""
)


def _money_sql(a: str, e: str, digits: int = 2) -> str:
    n = f"(({a} * {10**digits} + CAST(pow(10, {e}) AS BIGINT) // 2) // CAST(pow(10, {e}) AS BIGINT))"
    return "concat(format('{:,}', " + f"{n} // {10**digits}), '.', lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0'), ' ', currency)"


def _costs_sql(by: str, table: str = "r") -> str:
    each = f"SELECT {by}, currency, CAST(sum(amount_minor * CAST(pow(10, 6 - exponent) AS BIGINT)) // CAST(pow(10, 6 - max(exponent)) AS BIGINT) AS BIGINT) AS a, max(exponent) AS e FROM {table} WHERE amount_minor IS NOT NULL GROUP BY ALL"
    return f"SELECT {by}, string_agg({_money_sql('a', 'e')}, ' · ' ORDER BY currency) AS cost FROM ({each}) GROUP BY ALL"


def _count_sql(n: str, rest: str, one: str = "record") -> str:
    return f"CASE WHEN {n} > 0 THEN concat({_digits_sql(n)}, CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {one}s' END, '{rest}') END"


def _digits_sql(n: str) -> str:
    return "format('{:,}', CAST(" + n + " AS BIGINT))"


def _percent_sql(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN ({part} * 200 + {whole}) // ({whole} * 2) ELSE 0 END AS BIGINT)"


def _ago_sql(then: str, now: str) -> str:
    s = f"((epoch_us(TIMESTAMP '{now}') - epoch_us({then})) // 1000000)"
    return f"CASE WHEN {then} IS NULL THEN 'never' WHEN {s} < 10 THEN 'just now' WHEN {s} < 60 THEN concat({s}, 's ago') WHEN {s} < 3600 THEN concat({s} // 60, 'm ago') WHEN {s} < 86400 THEN concat({s} // 3600, 'h ago') ELSE concat({s} // 86400, 'd ago') END"


def _span_sql(a: str, b: str) -> str:
    return f"CASE WHEN strftime({a}, '%b %-d') = strftime({b}, '%b %-d') THEN strftime({a}, '%b %-d') ELSE strftime({a}, '%b %-d') || ' – ' || strftime({b}, '%b %-d') END"


def _runway_sql(m: str) -> str:
    return f"""CASE WHEN {m} IS NULL THEN '—' WHEN {m} < 1 THEN '<1m' WHEN {m} < 60 THEN concat({m}, 'm') WHEN {m} < 1440 THEN concat({m} // 60, 'h', CASE WHEN {m} % 60 > 0 THEN concat(' ', {m} % 60, 'm') END)
      ELSE concat({m} // 1440, 'd', CASE WHEN {m} // 60 % 24 > 0 THEN concat(' ', {m} // 60 % 24, 'h') END) END"""


def _tenths_sql(t: str) -> str:
    return f"concat({t} // 10, CASE WHEN {t} % 10 <> 0 THEN concat('.', {t} % 10) END, '%')"


_LABEL = "CASE source_app WHEN 'claude_code' THEN 'claude code' ELSE source_app END"
_WHERE = "source_app IN ('cursor', 'codex') AND model IN ('opus-1', 'sonnet-1')"
ORACLE_SQL: dict[str, str] = {
    "totals": f"{_RECORDS} SELECT {_T} FROM r",
    "totals_by_source": f"{_RECORDS} SELECT source_app, {_T} FROM r GROUP BY source_app",
    "totals_by_model": f"{_RECORDS} SELECT model, coalesce(model, 'Unknown model') AS label, {_T} FROM r GROUP BY model",
    "totals_grouping_sets": f"{_RECORDS} SELECT CAST(NULL AS VARCHAR) AS source_app, CAST(NULL AS VARCHAR) AS model, 'all' AS level, {_T} FROM r UNION ALL SELECT source_app, NULL, 'source', {_T} FROM r GROUP BY source_app UNION ALL SELECT NULL, model, 'model', {_T} FROM r GROUP BY model",
    "cost_by_currency": f"{_RECORDS} SELECT currency, CAST(sum(amount_minor * CAST(pow(10, 6 - exponent) AS BIGINT)) // CAST(pow(10, 6 - max(exponent)) AS BIGINT) AS BIGINT) AS amount_minor, max(exponent) AS exponent, count(*) AS counted FROM r WHERE amount_minor IS NOT NULL GROUP BY currency",
    "filtered_summary": f"{_RECORDS} SELECT source_app, model, {_T} FROM r WHERE {_WHERE} AND event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-20' GROUP BY source_app, model",
    "undated_excluded": f"{_RECORDS} SELECT count(*) AS undated_excluded FROM r WHERE {_WHERE} AND event_ts IS NULL",
    "recent_50": f"{_RECORDS} SELECT event_id, source_app, model, event_ts, display FROM r ORDER BY event_ts IS NULL, event_ts DESC, source_app || '_' || dedupe_key[1:16] LIMIT 50",
    "threads_top": f"""{_RECORDS}, p AS (SELECT source_app, session_id, project FROM r WHERE session_id IS NOT NULL AND project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_app, session_id ORDER BY event_ts IS NULL, event_ts DESC, event_id DESC) = 1),
      g AS (SELECT source_app, session_id, count(*) AS records, CAST(coalesce(sum(display), 0) AS BIGINT) AS display, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models, min(event_ts) AS first_event, max(event_ts) AS last_event FROM r WHERE session_id IS NOT NULL GROUP BY source_app, session_id)
      SELECT g.*, p.project FROM g LEFT JOIN p USING (source_app, session_id) ORDER BY display DESC, last_event DESC NULLS LAST, source_app, session_id LIMIT 100""",
    "threads_header": f"{_RECORDS} SELECT count(DISTINCT CASE WHEN session_id IS NOT NULL THEN source_app || session_id END) AS thread_count, CAST(coalesce(sum(display) FILTER (session_id IS NOT NULL), 0) AS BIGINT) AS attributed_tokens, count(*) FILTER (session_id IS NULL) AS unattributed FROM r",
    "share_of_total": f"{_RECORDS} SELECT model, CAST(coalesce(sum(display), 0) AS BIGINT) AS tokens, CAST(coalesce(coalesce(sum(display), 0) * 1000 // nullif((SELECT sum(display) FROM r), 0), 0) AS BIGINT) AS share_tenths FROM r GROUP BY model",
    "dedupe_keys": f"{_RECORDS} SELECT event_id, dedupe_key, source_app || '_' || dedupe_key[1:16] AS record_id FROM r",
    "content_hash": _RECORDS
    + "SELECT event_id, sha256(array_to_string(['v1', coalesce(strftime(event_ts, '%Y-%m-%d %H:%M:%S'), ''), coalesce(CASE WHEN model LIKE 'o%' THEN 'openai' END, ''), coalesce(model, ''), "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), ''), CASE WHEN {c} IS NULL THEN 'Unknown' ELSE 'Exact' END" for c in ("input", "output", "cached_input", "reasoning"))
    + ", coalesce(CAST(reported AS VARCHAR), ''), coalesce(project, ''), coalesce(session_id, ''), CASE WHEN amount_minor IS NULL THEN '' ELSE concat('ReportedBySource', chr(31), '', chr(31), amount_minor, '/', currency, '/', exponent) END], chr(31))) AS content_hash FROM r",
    "group_lists": f"{_RECORDS} SELECT coalesce(model, 'Unknown model') AS label, CAST(coalesce(sum(display), 0) AS BIGINT) AS display, format('{{:,}}', CAST(coalesce(sum(display), 0) AS BIGINT)) AS tokens, count(*) > count(display) AS partial, min(event_ts) AS first_event, max(event_ts) AS last_event FROM r GROUP BY model",
    "cost_display": f"{_RECORDS} SELECT event_id, CASE WHEN amount_minor IS NOT NULL THEN concat((amount_minor * 100 + CAST(pow(10, exponent) AS BIGINT) // 2) // CAST(pow(10, exponent) AS BIGINT) // 100, '.', lpad(CAST((amount_minor * 100 + CAST(pow(10, exponent) AS BIGINT) // 2) // CAST(pow(10, exponent) AS BIGINT) % 100 AS VARCHAR), 2, '0'), ' ', currency) END AS cost, coalesce(project, 'thread ' || session_id[1:6]) AS thread FROM r",
    "last_days": f"{_RECORDS} SELECT model, {_T} FROM r WHERE source_app = 'codex' AND event_ts >= TIMESTAMP '2024-01-01' GROUP BY model",
    "display_total_rules": f"{_RECORDS} SELECT CASE WHEN reported IS NOT NULL THEN 'source_reported' WHEN input IS NULL AND output IS NULL THEN 'unknown' WHEN reasoning IS NOT NULL THEN 'input_output_reasoning' ELSE 'input_output' END AS rule, count(*) AS n, CAST(coalesce(sum(display), 0) AS BIGINT) AS tokens FROM r GROUP BY 1",
    "timestamp_interpretation": "SELECT event_id, CASE WHEN event_id % 9 IN (0, 1, 2, 8) THEN 'explicit_offset' WHEN event_id % 9 IN (3, 6, 7) THEN 'assumed_utc' WHEN event_id % 9 = 4 THEN 'unparsable' ELSE 'missing' END AS kind, CASE WHEN event_id % 9 = 1 THEN ts WHEN event_id % 9 IN (0, 2, 3) THEN date_trunc('second', ts) WHEN event_id % 9 IN (6, 7) THEN date_trunc('minute', ts) WHEN event_id % 9 = 8 THEN CAST(make_timestamp(-1000000 * (epoch_us(ts) // 1000000)) AS TIMESTAMP) END AS parsed FROM events",
    "merge_classify": f"{_MERGE} SELECT outcome, count(*) AS n FROM o GROUP BY outcome",
    "merge_result": f"{_MERGE}, last AS (SELECT dedupe_key, h FROM o WHERE outcome <> 'unchanged' QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) = 1) SELECT dedupe_key, h AS content_hash FROM last UNION ALL SELECT dedupe_key, h FROM store WHERE dedupe_key NOT IN (SELECT dedupe_key FROM last)",
    "change_rows": f"{_MERGE} SELECT source_app, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome <> 'unchanged') > 0 AS data_changed FROM o GROUP BY source_app",
    "rejected_drafts": f"""{_RECORDS}, d AS (SELECT *, event_id % 16 AS e FROM r) SELECT CASE WHEN e = 1 THEN 'no source' WHEN e = 2 AND input > 0 THEN 'negative count' WHEN (e = 3 AND input IS NOT NULL) OR (e = 4 AND output IS NULL) THEN 'inconsistent token quality'
      WHEN amount_minor IS NOT NULL AND e IN (7, 8) THEN 'invalid cost' WHEN amount_minor IS NOT NULL AND e = 5 THEN 'missing pricing version' WHEN amount_minor IS NOT NULL AND e = 6 THEN 'contradictory cost status' END AS reason, count(*) AS n FROM d GROUP BY 1""",
    "quota_merge": f"""{_PACE}, a AS (SELECT * FROM s WHERE observed_at <= TIMESTAMP '2024-01-19 14:15:00' QUALIFY row_number() OVER (PARTITION BY source_app, pool ORDER BY observed_at DESC) = 1),
      z AS (SELECT * FROM s WHERE pool <> 'Other models' QUALIFY row_number() OVER (PARTITION BY source_app, pool ORDER BY observed_at DESC) = 1),
      u AS (SELECT * FROM a WHERE source_app <> 'cursor' OR pool IN (SELECT pool FROM z WHERE source_app = 'cursor') UNION ALL SELECT * FROM z)
      SELECT source_app, nullif(pool, '') AS label, used, resets_at, observed_at FROM u QUALIFY row_number() OVER (PARTITION BY source_app, pool ORDER BY observed_at DESC) = 1""",
    "health_states": f"""{_RECORDS}, a AS (SELECT source_app, event_id AS seq, ts, event_ts, event_id % 7 AS k FROM r),
      g AS (SELECT *, k IN (1, 5) AS good, max(CASE WHEN k IN (1, 5) THEN seq END) OVER w AS good_seq, max(CASE WHEN k IN (2, 3, 6) THEN seq END) OVER w AS bad_seq, last_value(CASE WHEN k = 5 THEN event_ts END IGNORE NULLS) OVER w AS seen, last_value(CASE WHEN k IN (1, 5) THEN ts END IGNORE NULLS) OVER w AS synced,
        first_value(CASE WHEN k IN (1, 5) THEN ts END IGNORE NULLS) OVER w AS first_sync, last_value(CASE WHEN k IN (2, 3, 6) THEN k END IGNORE NULLS) OVER w AS bad, last_value(CASE WHEN k IN (1, 5) THEN k = 5 END IGNORE NULLS) OVER w AS waiting FROM a WINDOW w AS (PARTITION BY source_app ORDER BY seq ROWS UNBOUNDED PRECEDING)),
      h AS (SELECT source_app, seq, ts AS last_attempt_at, CASE WHEN k IN (0, 4) THEN 'syncing' WHEN good THEN 'current' WHEN k = 2 THEN 'offline' ELSE 'error' END AS state, synced AS app_synced_at, coalesce(seen, first_sync) AS source_observed_at, CASE WHEN bad_seq > coalesce(good_seq, -1) THEN concat('error ', bad) END AS last_error, coalesce(waiting, FALSE) AS awaiting_upstream FROM g),
      m AS (SELECT *, coalesce(row(state, app_synced_at, source_observed_at, last_error, awaiting_upstream) IS DISTINCT FROM lag(row(state, app_synced_at, source_observed_at, last_error, awaiting_upstream)) OVER w, TRUE) AS material FROM h WINDOW w AS (PARTITION BY source_app ORDER BY seq))
      SELECT *, CAST(sum(CAST(material AS INTEGER)) OVER (PARTITION BY source_app ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM m""",
    "placeholders_retired": f"{_RECORDS}, f AS (SELECT source_app, max(event_ts) AS passed FROM r WHERE model IS NOT NULL GROUP BY source_app) SELECT source_app, CASE WHEN model IS NULL THEN 'local-activity' ELSE 'dashboard-window' END AS source_ref, count(*) AS n FROM r LEFT JOIN f USING (source_app) WHERE NOT (model IS NULL AND coalesce(event_ts <= passed, FALSE)) GROUP BY ALL",
    "replace_scope_delete": f"{_MERGE} SELECT dedupe_key FROM store WHERE NOT coalesce(source_app = 'codex' AND event_ts >= TIMESTAMP '2024-01-10' AND event_ts < TIMESTAMP '2024-01-15', FALSE) OR dedupe_key IN (SELECT dedupe_key FROM r WHERE display > 20000)",
    "quota_samples_change_only": f"{_SAMPLES} SELECT source_app, used, resets_at, observed_at FROM s",
    "quota_latest": f"{_SAMPLES} SELECT * FROM live WHERE resets_at > TIMESTAMP '2024-01-20 15:00:00'",
    "quota_pools": f"{_PACE} SELECT source_app, nullif(pool, '') AS label, used, resets_at, observed_at, row_number() OVER (PARTITION BY source_app ORDER BY greatest(0, 1000 - used), pool) = 1 AS tightest FROM quotas",
    "calibration_spans": f"{_PACE} SELECT source_app, pool, CAST(window_minutes AS BIGINT) AS window_minutes, t0, t1, moved, units FROM spans",
    "calibration_fit": f"{_PACE} SELECT source_app, pool, CAST(window_minutes AS BIGINT) AS window_minutes, n_spans, rate, residual_percent, provisional FROM fit WHERE rate IS NOT NULL",
    "projection": f"{_PACE} SELECT source_app, pool, CAST(window_minutes AS BIGINT) AS window_minutes, used, added, projected FROM projection",
    "pace_states": f"""{_PACE} SELECT source_app, nullif(pool, '') AS label, CAST(1440 AS BIGINT) AS window_minutes, CAST(used AS BIGINT) AS used, CAST(remaining AS BIGINT) AS remaining, CAST(left_min AS BIGINT) AS until_reset, CAST(age AS BIGINT) AS age, aged, state, CAST(runway AS BIGINT) AS runway,
      CAST(CASE WHEN state = 'green' THEN runway - left_min END AS BIGINT) AS slack, CAST(CASE WHEN state = 'red' THEN left_min - runway END AS BIGINT) AS shortfall, CAST(left_min * 100 // nullif(runway, 0) AS BIGINT) AS pace_ratio,
      CASE WHEN ratio < 75 THEN 'below' WHEN ratio < 150 THEN 'typical' WHEN ratio < 250 THEN 'above' WHEN ratio IS NOT NULL THEN 'farAbove' END AS vs_baseline, basis, CASE WHEN basis = 'trailing' THEN horizon END AS basis_minutes,
      CAST(CASE WHEN state = 'red' THEN 0 WHEN runway IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS urgency, CAST(runway AS BIGINT) AS urgency_value FROM pace""",
    "binding_window": f"{_PACE} SELECT source_app, nullif(pool, '') AS label, CAST(1440 AS BIGINT) AS window_minutes, state, CAST(confirmed_remaining AS BIGINT) AS confirmed_remaining, CAST(runway AS BIGINT) AS runway FROM b",
    "status_line": f"""{_PACE} SELECT coalesce(string_agg(concat(CASE source_app WHEN 'claude_code' THEN 'claude' ELSE source_app END, ' ', (confirmed_remaining + 5) // 10, '%', CASE state WHEN 'red' THEN '↓' || {_SHORT.format("runway")} WHEN 'amber' THEN '~' WHEN 'exhausted' THEN '×' ELSE '' END, '·', {_SHORT.format("left_min")}), ' · ' ORDER BY list_position(['codex', 'claude_code', 'cursor'], source_app)), '—') AS line FROM b""",
    "alerts_active": f"""{_PACE}, limits AS (SELECT * FROM (VALUES ('remaining_percent', 45), ('minutes_until_reset', 600), ('projected_exhaustion', 60)) AS v(metric, limit_value)),
      j AS (SELECT *, greatest(0, 1000 - confirmed) AS have, greatest(0, -((-((epoch_us(resets_at) - epoch_us(TIMESTAMP '2024-01-20 15:00:00')) // 1000000)) // 60)) AS minutes, CASE WHEN state = 'red' THEN left_min - runway END AS short FROM pace CROSS JOIN limits),
      one AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY source_app, metric ORDER BY CASE metric WHEN 'remaining_percent' THEN have WHEN 'minutes_until_reset' THEN minutes ELSE coalesce(left_min - short, 1152921504606846976) END, pool) = 1),
      k AS (SELECT *, concat_ws(':', source_app, 1440, CASE metric WHEN 'remaining_percent' THEN 'RemainingPercent' WHEN 'minutes_until_reset' THEN 'MinutesUntilReset' ELSE 'ProjectedExhaustion' END, limit_value, epoch_us(resets_at) // 1000000) AS alert_key FROM one
        WHERE CASE metric WHEN 'remaining_percent' THEN have // 10 <= limit_value WHEN 'minutes_until_reset' THEN minutes <= limit_value ELSE coalesce(short >= limit_value, FALSE) END)
      SELECT source_app, CAST(1440 AS BIGINT) AS window_minutes, metric, CAST(limit_value AS BIGINT) AS limit_value, alert_key, CASE source_app WHEN 'cursor' THEN 'Cursor' WHEN 'codex' THEN 'Codex' ELSE 'Claude' END || ' running low' AS title,
        CASE metric WHEN 'remaining_percent' THEN concat(have // 10, CASE WHEN have % 10 <> 0 THEN concat('.', have % 10) ELSE '' END, '% left this window · threshold ', limit_value, '%') WHEN 'minutes_until_reset' THEN concat('resets in ', minutes, ' min this window · threshold ', limit_value, ' min')
          ELSE concat('projected to run out ', short, ' min early this window · threshold ', limit_value, ' min') END AS body FROM k WHERE alert_key <> 'cursor:1440:MinutesUntilReset:600:1705795200'""",
    "source_strip": f"""{_PACE}, g AS (SELECT source_app, CAST(coalesce(sum(display), 0) AS BIGINT) AS t, (SELECT sum(display) FROM r) AS w FROM r GROUP BY source_app), c AS ({_costs_sql("source_app")}), l AS (SELECT * FROM quotas WHERE source_app = 'cursor'),
      one AS (SELECT source_app, min(used) AS meter FROM l GROUP BY source_app HAVING count(*) = 1)
      SELECT source_app, NULL AS pool, {_LABEL} AS name, CAST(CASE WHEN meter IS NOT NULL THEN (meter + 5) // 10 ELSE {_percent_sql("t", "w")} END AS BIGINT) AS percent, {_digits_sql("t")} AS figure, coalesce(cost, '—') AS cost FROM g LEFT JOIN c USING (source_app) LEFT JOIN one USING (source_app)
      UNION ALL SELECT source_app, pool, lower(pool), (used + 5) // 10, concat({_tenths_sql("greatest(0, 1000 - used)")}, ' left'), '—' FROM l WHERE (SELECT count(*) FROM l) > 1""",
    "model_rows": f"""{_RECORDS}, m AS (SELECT *, coalesce(model, 'Unknown model') AS label FROM r), c AS ({_costs_sql("label", "m")}), g AS (SELECT label, CAST(coalesce(sum(display), 0) AS BIGINT) AS t, count(*) - count(display) AS u, (SELECT sum(display) FROM r) AS w FROM m GROUP BY label)
      SELECT label, {_digits_sql("t")} AS tokens, {_percent_sql("t", "w")} AS percent, coalesce(cost, '—') AS cost, {_count_sql("u", " did not report this")} AS gaps FROM g LEFT JOIN c USING (label)""",
    "thread_list": f"""{_RECORDS}, o AS (SELECT * FROM r WHERE session_id IS NOT NULL), c AS ({_costs_sql("source_app, session_id", "o")}),
      p AS (SELECT source_app, session_id, project FROM o WHERE project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_app, session_id ORDER BY event_ts IS NULL, event_ts DESC, event_id DESC) = 1),
      g AS (SELECT source_app, session_id, CAST(coalesce(sum(display), 0) AS BIGINT) AS t, min(event_ts) AS a, max(event_ts) AS b FROM o GROUP BY source_app, session_id), h AS (SELECT count(*) AS threads, sum(t) AS w, (SELECT count(*) FROM r WHERE session_id IS NULL) AS none FROM g)
      SELECT source_app, session_id, coalesce(project, 'thread ' || session_id[1:6]) AS name, {_span_sql("a", "b")} AS span, {_digits_sql("t")} AS tokens, {_percent_sql("t", "w")} AS percent, coalesce(cost, '—') AS cost,
        nullif(concat_ws(' · ', CASE WHEN threads > 50 THEN concat('showing 50 of ', threads) END, {_count_sql("none", " not tied to a thread", "event")}), '') AS foot
      FROM g CROSS JOIN h LEFT JOIN p USING (source_app, session_id) LEFT JOIN c USING (source_app, session_id) ORDER BY t DESC, b DESC NULLS LAST, source_app, session_id LIMIT 50""",
    "stat_bar": f"""{_RECORDS}, o AS (SELECT *, 1 AS one FROM r WHERE {_WHERE} AND event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-20'), c AS ({_costs_sql("one", "o")}),
      g AS (SELECT coalesce(sum(display), 0) AS t, coalesce(sum(input), 0) AS i, coalesce(sum(output), 0) AS o, count(*) AS n, count(*) - count(display) AS u, count(*) - count(amount_minor) AS f, min(event_ts) AS a, max(event_ts) AS b FROM o)
      SELECT {_digits_sql("t")} AS tokens, concat({_digits_sql("i")}, ' in · ', {_digits_sql("o")}, ' out') AS in_out, {_count_sql("u", " did not report this")} AS gaps, coalesce((SELECT cost FROM c), '—') AS cost, CASE WHEN f > 0 THEN concat({_digits_sql("f")}, ' without cost') END AS cost_gaps, {_digits_sql("n")} AS events, {_span_sql("a", "b")} AS span FROM g""",
    "quota_rows": f"""{_PACE}, j AS (SELECT q.source_app, q.pool, q.used, q.resets_at, q.observed_at, a.added, a.projected, f.n_spans, f.residual_percent, f.provisional, p.state, p.runway, p.left_min, p.aged, p.ratio, p.basis, p.horizon, coalesce(a.projected, q.used) AS live,
        greatest(0, (epoch_us(q.resets_at) - epoch_us(TIMESTAMP '2024-01-20 15:00:00') + 30000000) // 60000000) AS until FROM quotas q LEFT JOIN projection a USING (source_app, pool) LEFT JOIN fit f USING (source_app, pool) LEFT JOIN pace p USING (source_app, pool))
      SELECT source_app, pool, CAST(1440 AS BIGINT) AS window_minutes, CASE WHEN pool = '' THEN 'day' ELSE lower(pool) END AS name, concat(CASE WHEN projected IS NOT NULL THEN '≈' END, {_tenths_sql("greatest(0, 1000 - live)")}, ' left') AS "left", least(1000, used) AS confirmed_tenths, least(1000, live) AS live_tenths,
        CAST(CASE WHEN until < 1440 THEN round(least(100, (1440 - until) / 1440 * 100)) END AS BIGINT) AS even_pace, CASE WHEN aged THEN '≈' ELSE '' END || CASE state WHEN 'red' THEN concat('out in ', {_runway_sql("runway")}) WHEN 'amber' THEN 'at the edge' WHEN 'green' THEN CASE WHEN runway IS NULL THEN 'idle' ELSE 'on track' END WHEN 'exhausted' THEN 'used up' END AS verdict,
        CASE WHEN state = 'red' THEN concat({_runway_sql("(left_min - runway)")}, ' short') END AS gap, CASE WHEN CAST(resets_at AS DATE) = DATE '2024-01-20' THEN '' ELSE strftime(resets_at, 'resets %b %-d %H:%M') END AS reset,
        concat_ws(chr(10), CASE state WHEN 'red' THEN concat('runs out ', {_runway_sql("(left_min - runway)")}, ' early at this pace') WHEN 'amber' THEN concat({_runway_sql("runway")}, ' of usage left · right at the edge of the window') WHEN 'green' THEN CASE WHEN runway IS NULL THEN 'nothing being spent' ELSE concat({_runway_sql("runway")}, ' of usage left · comfortably inside the window') END WHEN 'exhausted' THEN 'allowance used up' ELSE 'too early to say' END,
          CASE WHEN ratio < 75 THEN 'lighter than your usual right now' WHEN ratio >= 250 THEN 'far heavier than your usual right now' WHEN ratio >= 150 THEN 'heavier than your usual right now' END, CASE basis WHEN 'window_open' THEN 'averaged since the window opened' WHEN 'trailing' THEN concat('measured over the last ', horizon, 'm') END, CASE WHEN aged THEN concat('from a reading ', {_ago_sql("observed_at", "2024-01-20 15:00:00")}, '; nothing spent since, so it can only be optimistic') END) AS detail,
        CASE WHEN projected IS NOT NULL THEN concat({_tenths_sql("used")}, ' confirmed ', {_ago_sql("observed_at", "2024-01-20 15:00:00")}, chr(10), '+', {_tenths_sql("added")}, ' estimated from usage since', chr(10), CASE WHEN provisional THEN 'rate from a single reading so far, not yet corroborated' ELSE concat('rate fitted from ', n_spans, ' readings, typically within ±', residual_percent, '%') END) END AS projection FROM j""",
    "event_details": _RECORDS
    + "SELECT event_id, "
    + ", ".join(f"concat_ws(' ', coalesce({_digits_sql(c)}, '—'), CASE WHEN {c} IS NULL THEN 'not reported'{more} END) AS {c}" for c, more in (("input", " WHEN event_id % 3 = 0 THEN 'estimated by the source'"), ("output", " WHEN event_id % 3 = 1 THEN 'the source reported only part of this'"), ("cached_input", ""), ("reasoning", "")))
    + f""", concat_ws(' ', coalesce({_digits_sql("display")}, '—'), CASE WHEN reported IS NOT NULL THEN 'total reported by the source' WHEN input IS NULL AND output IS NULL THEN NULL WHEN reasoning IS NOT NULL THEN 'input + output + reasoning' ELSE 'input + output' END) AS total,
      CASE WHEN amount_minor IS NULL THEN '—' ELSE concat({_money_sql("amount_minor", "exponent", 4)}, ' ', CASE WHEN currency <> 'EUR' THEN 'reported by the source' WHEN event_id % 2 = 0 THEN 'priced locally · v7' ELSE 'priced locally · —' END) END AS cost,
      CASE WHEN model LIKE 'o%' THEN 'openai' ELSE '—' END AS provider, coalesce(project, '—') AS project, coalesce(session_id, '—') AS session, CASE WHEN event_ts IS NULL THEN 'the log recorded no timestamp' END AS logged_note FROM r""",
    "limit_options": f"""{_RECORDS}, o AS (SELECT source_app, CASE event_id % 3 WHEN 0 THEN 'remaining_percent' WHEN 1 THEN 'minutes_until_reset' ELSE 'projected_exhaustion' END AS metric, input AS limit_value, event_id % 2 = 0 AS enabled FROM r WHERE source_app <> 'cursor' QUALIFY row_number() OVER (PARTITION BY source_app ORDER BY event_id DESC) = 1
      UNION ALL SELECT 'cursor', 'remaining_percent', 25, TRUE)
      SELECT *, CASE WHEN limit_value IS NULL OR limit_value < 0 OR limit_value > CASE metric WHEN 'remaining_percent' THEN 100 ELSE 10080 END THEN 'limit out of range' END AS problem FROM o""",
    "session_tiling": f"""{_RECORDS.replace("WITH e AS", "WITH RECURSIVE e AS", 1)}, t AS MATERIALIZED (SELECT session_id, event_ts AS t FROM r WHERE session_id IS NOT NULL AND event_ts <= TIMESTAMP '2024-01-20 15:00:00'),
      w AS (SELECT session_id, min(t) AS o FROM t GROUP BY session_id UNION ALL SELECT w.session_id, min(t.t) FROM w JOIN t ON t.session_id = w.session_id AND t.t >= w.o + INTERVAL 5 HOUR WHERE w.o + INTERVAL 5 HOUR <= TIMESTAMP '2024-01-20 15:00:00' GROUP BY w.session_id)
      SELECT session_id, CASE WHEN max(o) + INTERVAL 5 HOUR > TIMESTAMP '2024-01-20 15:00:00' THEN max(o) + INTERVAL 5 HOUR END AS resets_at FROM w GROUP BY session_id""",
    "baseline_median_hour": f"{_RECORDS}, cell AS (SELECT source_app, CAST(event_ts AS DATE) AS d, hour(event_ts) AS h, sum(display) AS t FROM r WHERE event_ts >= TIMESTAMP '2024-01-01' AND display IS NOT NULL GROUP BY ALL) SELECT source_app, CAST(h AS INTEGER) AS hour, count(*) AS n_days, CAST(CASE WHEN count(*) >= 3 THEN list_sort(list(t))[(count(*) - 1) // 2 + 1] END AS BIGINT) AS median_tokens FROM cell GROUP BY source_app, h",
    "duty_cycle": f"{_RECORDS}, cell AS (SELECT source_app, CAST(event_ts AS DATE) AS d, hour(event_ts) AS h, min(event_ts) AS t FROM r WHERE event_ts >= TIMESTAMP '2024-01-01' AND display IS NOT NULL GROUP BY ALL) SELECT source_app, count(*) AS active_hours, CAST(CASE WHEN count(*) >= 24 THEN least(100, count(*) * 100 // least(720, greatest(1, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(t))) // 3600000000))) END AS BIGINT) AS duty_percent FROM cell GROUP BY source_app",
    "burn_rate": f"{_RECORDS} SELECT source_app, CAST(sum(display) * 60 // 60 AS BIGINT) AS tokens_per_hour FROM r WHERE event_ts >= TIMESTAMP '2024-01-20 14:00:00' AND display IS NOT NULL GROUP BY source_app",
    "hourly_tumbling": f"{_RECORDS} SELECT source_app, date_trunc('hour', event_ts) AS hour_start, count(*) AS n, CAST(coalesce(sum(display), 0) AS BIGINT) AS tokens FROM r WHERE event_ts IS NOT NULL GROUP BY ALL",
    "conversation_turns": """
      WITH b AS (SELECT conv_id AS conversation, turn AS "at", concat_ws(':', role, sha256(text)) AS bubble, coalesce(role = 'user', FALSE) AS is_user,
        CASE WHEN turn % 3 = 0 THEN 'm' || CAST(conv_id % 4 AS VARCHAR) END AS model, CASE WHEN role <> 'user' AND length(text) % 3 <> 0 THEN length(text) ELSE 0 END AS tokens FROM conversations),
      t AS (SELECT *, sum(CAST(is_user AS INT)) OVER w AS turn_no, last_value(model IGNORE NULLS) OVER w AS carried, NOT is_user AND tokens > 0 AS paid FROM b WINDOW w AS (PARTITION BY conversation ORDER BY "at", bubble ROWS UNBOUNDED PRECEDING)),
      c AS (SELECT *, bool_or(paid) OVER (PARTITION BY conversation, turn_no) AS covered FROM t)
      SELECT conversation, "at", bubble, CASE WHEN paid THEN 'tokens' ELSE 'event' END AS kind, CASE WHEN paid THEN carried ELSE model END AS model, CASE WHEN paid THEN tokens END AS tokens FROM c WHERE paid OR (is_user AND NOT covered)""",
}
_ALERTS = ORACLE_SQL["alerts_active"]
_KEYED = _ALERTS[: _ALERTS.index("      SELECT source_app, CAST(1440")]
ORACLE_SQL["alert_board"] = f"{_KEYED} SELECT source_app, CAST(1440 AS BIGINT) AS window_minutes, metric, alert_key, alert_key <> '{SNOOZED}' AS fires FROM k"
ORACLE_SQL["alerts_by_options"] = _ALERTS.replace(f"alert_key <> '{SNOOZED}'", "source_app = 'codex' AND metric = 'minutes_until_reset'")
ORACLE_SQL["pace_order"] = f"{_PACE} SELECT row_number() OVER (ORDER BY CASE WHEN state = 'red' THEN 0 WHEN runway IS NOT NULL THEN 1 ELSE 2 END, runway NULLS FIRST, pool, source_app) - 1 AS place, source_app, nullif(pool, '') AS label, state, CAST(runway AS BIGINT) AS runway FROM pace"
ORACLE_SQL["quota_groups"] = f"{_PACE} SELECT row_number() OVER (ORDER BY list_position(['codex', 'claude_code', 'cursor'], source_app), pool) - 1 AS place, source_app, pool, CAST(1440 AS BIGINT) AS window_minutes, used FROM quotas"
ORACLE_SQL["awaiting_billing"] = f"{_RECORDS} SELECT source_app, coalesce(max(event_ts) > max(event_ts) FILTER (project IS NOT NULL), max(event_ts) IS NOT NULL) AS awaiting_upstream FROM r GROUP BY source_app"
ORACLE_SQL["menu_rows"] = f"""{_PACE}, m1 AS (SELECT 0 AS b, list_position(['cursor', 'claude_code', 'codex'], source_app) AS o, pool AS n, concat_ws(':', 'quota', source_app, 1440, pool) AS id,
      concat(CASE source_app WHEN 'claude_code' THEN 'claude' ELSE source_app END, CASE WHEN pool <> '' THEN ' ' || lower(pool) ELSE '' END, ' · ', (greatest(0, 1000 - used) + 5) // 10, '% of the day left · resets ', strftime(resets_at, '%b %-d, %-I:%M%p')) AS text FROM quotas),
    t AS (SELECT source_app, {_LABEL} AS name, coalesce(sum(display), 0) AS t FROM r GROUP BY source_app), c AS (SELECT currency, CAST(sum(amount_minor * CAST(pow(10, 6 - exponent) AS BIGINT)) // CAST(pow(10, 6 - max(exponent)) AS BIGINT) AS BIGINT) AS a, max(exponent) AS e FROM r WHERE amount_minor IS NOT NULL GROUP BY currency ORDER BY currency LIMIT 1),
    lines AS (SELECT * FROM m1 UNION ALL SELECT 1, 0, '', 'total', concat((SELECT {_digits_sql("sum(t)")} FROM t), ' tokens') UNION ALL SELECT 2, 0, '', 'cost', {_money_sql("a", "e")} FROM c UNION ALL SELECT 3, -t, name, 'source:' || source_app, concat(name, '  ', {_digits_sql("t")}) FROM t)
    SELECT CAST(row_number() OVER (ORDER BY b, o, n) - 1 AS INTEGER) AS position, id, text FROM lines"""
ORACLE_SQL["session_tiling_from_resets"] = f"""{_RECORDS.replace("WITH e AS", "WITH RECURSIVE e AS", 1)}, t AS MATERIALIZED (SELECT session_id, event_ts AS t FROM r WHERE session_id IS NOT NULL AND event_ts <= TIMESTAMP '2024-01-20 15:00:00'),
  k AS (SELECT session_id, min(t) + INTERVAL 12 HOUR AS reset FROM t GROUP BY session_id),
  w AS (SELECT session_id, min(t) AS o FROM t JOIN k USING (session_id) WHERE t >= reset GROUP BY session_id UNION ALL SELECT w.session_id, min(t.t) FROM w JOIN t ON t.session_id = w.session_id AND t.t >= w.o + INTERVAL 5 HOUR WHERE w.o + INTERVAL 5 HOUR <= TIMESTAMP '2024-01-20 15:00:00' GROUP BY w.session_id),
  z AS (SELECT session_id, max(o) AS o FROM w GROUP BY session_id)
  SELECT session_id, CASE WHEN o + INTERVAL 5 HOUR > TIMESTAMP '2024-01-20 15:00:00' THEN o + INTERVAL 5 HOUR END AS resets_at FROM k LEFT JOIN z USING (session_id)"""
_HEALTH = ORACLE_SQL["health_states"].replace("SELECT *, CAST(sum(CAST(material", ", h2 AS (SELECT *, CAST(sum(CAST(material", 1)
_WORD = "CASE WHEN state = 'current' THEN CASE WHEN awaiting_upstream THEN 'awaiting billing' ELSE 'watching' END ELSE state END"
_CLOCKS = [f"concat('{words} ', {_ago_sql(clock, '2024-01-31 00:00:00')})" for words, clock in (("app synced", "app_synced_at"), ("source reported", "source_observed_at"))]
ORACLE_SQL["health_rows"] = f"""{_HEALTH.rstrip()}), z AS (SELECT * FROM h2 QUALIFY row_number() OVER (PARTITION BY source_app ORDER BY seq DESC) = 1)
  SELECT source_app, {_LABEL} AS label, {_WORD} AS word, {_CLOCKS[0]} AS synced, {_CLOCKS[1]} AS reported, CASE WHEN state IN ('offline', 'error') THEN last_error || CASE WHEN state = 'offline' AND source_app = 'cursor' THEN ' · retrying with backoff' ELSE '' END END AS failure,
    concat_ws(' · ', {_WORD}, {_CLOCKS[0]}, {_CLOCKS[1]}, CASE WHEN awaiting_upstream THEN 'activity detected; awaiting billing data' END, 'last error: ' || last_error) AS freshness FROM z"""
_COMMITS = f"""{_MERGE}, f2 AS (SELECT dedupe_key, h FROM batch QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) = 1),
  s2 AS (SELECT r.*, f2.h, s.h AS h1, coalesce(display > 20000, FALSE) AS again, {_HASH.format("display")} AS h3, coalesce(source_app = 'codex' AND event_ts >= TIMESTAMP '2024-01-10' AND event_ts < TIMESTAMP '2024-01-15', FALSE) AS held
    FROM r JOIN f2 USING (dedupe_key) LEFT JOIN (SELECT dedupe_key, h FROM store) s USING (dedupe_key)),
  s3 AS (SELECT * FROM s2 WHERE again OR NOT held),
  n AS (SELECT * REPLACE (CASE WHEN again OR NOT (event_id % 10 = 0 OR event_id % 6 = 4) THEN display ELSE display + 1 END AS display) FROM s3)"""
_N = "CAST(count(*) FILTER ({}) AS BIGINT) AS {}"
ORACLE_SQL["ledger_after_commits"] = f"{_COMMITS} SELECT dedupe_key, CASE WHEN again THEN h3 ELSE h END AS content_hash, CAST(CASE WHEN again AND h3 <> h THEN 3 WHEN h1 = h THEN 1 ELSE 2 END AS BIGINT) AS revision FROM s3"
ORACLE_SQL["ledger_folded_totals"] = f"{_COMMITS} SELECT source_app, model, {_T} FROM n GROUP BY source_app, model"
ORACLE_SQL["ledger_folded_costs"] = f"{_COMMITS} SELECT source_app, currency, CAST(sum(amount_minor * CAST(pow(10, 6 - exponent) AS BIGINT)) // CAST(pow(10, 6 - max(exponent)) AS BIGINT) AS BIGINT) AS amount_minor, max(exponent) AS exponent, count(*) AS counted FROM n WHERE amount_minor IS NOT NULL GROUP BY source_app, currency"
ORACLE_SQL["ledger_published"] = f"""{_COMMITS} SELECT CAST(1 AS BIGINT) AS "commit", CAST(1 AS BIGINT) AS revision, source_app, {_N.format("TRUE", "inserted")}, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS unchanged FROM store GROUP BY source_app
  UNION ALL SELECT 2, 2, source_app, {_N.format("h1 IS NULL", "inserted")}, {_N.format("h1 <> h", "updated")}, 0, {_N.format("h1 = h", "unchanged")} FROM s2 GROUP BY source_app
  UNION ALL SELECT 3, 3, source_app, 0, {_N.format("again AND h3 <> h", "updated")}, {_N.format("held AND NOT again", "deleted")}, {_N.format("again AND h3 = h", "unchanged")} FROM s2 WHERE again OR held AND source_app = 'codex' GROUP BY source_app"""
