"""The rows that a screen shows, each view one frame: sources, threads, totals, allowances, events, health, and all at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import wording as T
from ..schema import MENU_WORDS, SOURCE_LABELS, SOURCES, named
from . import ledger, series
from .series import KEY, at, pooled, tightest_quotas

if TYPE_CHECKING:
    from ..streaming.ledger import State

#: The source whose row shows its allowance instead of its share, and the fixed order in which a list names sources.
METERED = SOURCES[0]
READING_ORDER = tuple(reversed(SOURCES))


def cost_text(records: DataFrame, *by: str) -> DataFrame:
    """The costs of each group in one text, each currency for itself."""
    each = ledger.cost_by_currency(records, *by).withColumn("text", X.format_money(F.col("amount_minor"), F.col("exponent"), F.col("currency")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("currency", "text"))), lambda c: c.text)  # as many as there are currencies
    return each.groupBy(*by).agg(F.array_join(parts, " · ").alias("cost"))


def source_strip(records: DataFrame, quotas: DataFrame) -> DataFrame:
    """One row for each source with its share of all tokens and its cost, and one for each pool of the metered source.

    If that source has a single allowance, its own row shows how much of it is used in place of the share; with several,
    each is a row of its own (`pool`) below it. `records` are unfiltered, so a filter never changes the shares.
    """
    groups = ledger.share_of_total(records, "source_app").select("source_app", "tokens")
    whole = records.agg(F.sum(F.col("display").cast("decimal(38,0)")).alias("whole"))  # one row
    metered = pooled(quotas).filter(F.col("source_app") == METERED)
    meter = tightest_quotas(metered).join(metered.groupBy("source_app").agg(F.count("*").alias("pools")), "source_app").filter("pools = 1").select("source_app", F.col("used").alias("meter"))
    rows = groups.crossJoin(F.broadcast(whole)).join(cost_text(records, "source_app"), "source_app", "left").join(meter, "source_app", "left")
    percent = F.when(F.col("meter").isNotNull(), X.round_tenths(F.col("meter"))).otherwise(T.share_percent(F.col("tokens"), F.col("whole")))
    name = named(F.col("source_app"), SOURCE_LABELS)
    sources = rows.select("source_app", F.lit(None).cast("string").alias("pool"), name.alias("name"), percent.cast("long").alias("percent"), X.group_digits(F.col("tokens")).alias("figure"), T.or_unknown(F.col("cost")).alias("cost"))
    several = metered.withColumn("n", F.count("*").over(Window.partitionBy("source_app"))).filter("n > 1")
    left = T.text(X.format_tenths(F.greatest(F.lit(0), 1000 - F.col("used"))), " left")
    pools = several.select("source_app", "pool", F.lower("label").alias("name"), X.round_tenths(F.col("used")).cast("long").alias("percent"), left.alias("figure"), F.lit(T.UNKNOWN).alias("cost"))
    return sources.unionByName(pools)


def model_rows(records: DataFrame) -> DataFrame:
    """Tokens, cost and whole percent of each model, an unknown one by that name."""
    whole = records.agg(F.sum(F.col("display").cast("decimal(38,0)")).alias("whole"))  # one row
    r = records.withColumn("label", F.coalesce("model", F.lit("Unknown model")))
    rows = ledger.totals(r, "label").join(cost_text(r, "label"), "label", "left").crossJoin(F.broadcast(whole))
    return rows.select("label", X.group_digits(F.col("display")).alias("tokens"), T.share_percent(F.col("display"), F.col("whole")).alias("percent"), T.or_unknown(F.col("cost")).alias("cost"), T.total_gaps(F.col("display_unknown")).alias("gaps"))


def thread_list(records: DataFrame, n: int | None = None) -> DataFrame:
    """The largest threads with their share of all records that belong to one, and a note on what the list leaves out."""
    head = ledger.threads_header(records)  # one row
    shown = F.least(F.col("thread_count"), F.lit(ledger.effective_limit(n)))
    cut = F.when(F.col("thread_count") > shown, T.text("showing ", shown, " of ", F.col("thread_count")))
    foot = T.noted(cut, T.counted(F.col("unattributed"), "event", "events", " not tied to a thread"))
    top = ledger.top_threads(records, n)
    costs = cost_text(records.join(top.select("source_app", "session_id"), ["source_app", "session_id"], "left_semi"), "source_app", "session_id")
    rows = top.join(costs, ["source_app", "session_id"], "left").crossJoin(F.broadcast(head))
    return rows.select("source_app", "session_id", X.thread_name(F.col("project"), F.col("session_id")).alias("name"), T.day_span(F.col("first_event"), F.col("last_event")).alias("span"), X.group_digits(F.col("display")).alias("tokens"), T.share_percent(F.col("display"), F.col("attributed_tokens")).alias("percent"), T.or_unknown(F.col("cost")).alias("cost"), foot.alias("foot"))


def stat_bar(records: DataFrame) -> DataFrame:
    """Tokens, cost and events of a selection, each with what its figure leaves out."""
    total = ledger.totals(records).crossJoin(ledger.date_span(records)).crossJoin(cost_text(records).agg(F.max("cost").alias("cost")))  # one row each
    n = lambda c: X.group_digits(F.col(c))
    without = F.when(F.col("records_without_cost") > 0, T.text(n("records_without_cost"), " without cost"))
    return total.select(n("display").alias("tokens"), T.text(n("input"), " in · ", n("output"), " out").alias("in_out"), T.total_gaps(F.col("display_unknown")).alias("gaps"), T.or_unknown(F.col("cost")).alias("cost"), without.alias("cost_gaps"), n("records").alias("events"), T.day_span(F.col("first_event"), F.col("last_event")).alias("span"))


def quota_rows(quotas: DataFrame, projections: DataFrame, fits: DataFrame, paced: DataFrame, now: datetime) -> DataFrame:
    """Each allowance as a row: what is left as far as is known now (≈ where projected), verdict, gap, reset, and notes."""
    t = at(now)
    ahead = projections.select(*KEY, "added", "projected")
    fit = fits.select(*KEY, "n_spans", "residual_percent", "provisional")
    judged = paced.select(*KEY, "state", "runway", "shortfall", "aged", "vs_baseline", "basis", "basis_minutes")
    q = pooled(quotas).join(ahead, KEY, "left").join(fit, KEY, "left").join(judged, KEY, "left")
    live, until = F.coalesce("projected", "used"), X.minutes_round(t, F.col("resets_at"))
    derived = F.col("projected").isNotNull()
    mark = lambda c: F.when(c, "≈").otherwise("")
    even = F.when(F.col("resets_at").isNotNull(), X.even_pace_percent(until, F.col("window_minutes")))
    state, runway, shortfall = F.col("state"), F.col("runway"), F.col("shortfall")
    return q.select(
        *KEY,
        T.pool_name(F.col("label"), F.col("source_app"), F.col("window_minutes")).alias("name"),
        T.text(mark(derived), X.format_tenths(F.greatest(F.lit(0), 1000 - live)), " left").alias("left"),
        F.least(F.lit(1000), F.col("used")).cast("long").alias("confirmed_tenths"),
        F.least(F.lit(1000), live).cast("long").alias("live_tenths"),
        F.round(even).cast("long").alias("even_pace"),
        T.text(mark(F.coalesce("aged", F.lit(False))), T.pace_compact(state, runway)).alias("verdict"),
        T.pace_gap(state, shortfall).alias("gap"),
        T.reset_text(F.col("resets_at"), t).alias("reset"),
        T.noted(T.pace_sentence(state, runway, shortfall), T.vs_baseline_note(F.col("vs_baseline")), T.basis_note(F.col("basis"), F.col("basis_minutes")), T.reading_note(F.col("aged"), F.col("observed_at"), t), by="\n").alias("detail"),
        F.when(derived, T.projection_note(F.col("used"), F.col("observed_at"), F.col("added"), F.col("provisional"), F.col("n_spans"), F.col("residual_percent"), t)).alias("projection"),
    )


def in_reading_order(rows: DataFrame) -> DataFrame:
    """Sources in their fixed order, shorter windows first, then labels."""
    return rows.orderBy(F.array_position(F.array(*map(F.lit, READING_ORDER)), F.col("source_app")), "window_minutes", "pool")


def event_details(records: DataFrame) -> DataFrame:
    """All that is known of each record, and why a figure may not be what it seems.

    Beside the columns of records, `timestamp_interpretation`, `cost_status` and `pricing_version` are read, and the quality
    of each count where the records have one.
    """
    plain = lambda c: F.when(F.col(c).isNull(), "unknown").otherwise("exact")
    quality_of = lambda c: F.coalesce(F.col(f"{c}_quality"), plain(c)) if f"{c}_quality" in records.columns else plain(c)
    counts = {c: (X.group_digits(F.col(c)), quality_of(c)) for c in ("input", "output", "cached_input", "reasoning")}
    rule = X.total_rule(*map(F.col, ("reported", "input", "output", "reasoning")))
    priced = F.col("amount_minor").isNotNull()
    return records.select(
        "event_id",
        *(T.noted(T.or_unknown(figure), T.quality_note(quality), by=" ").alias(c) for c, (figure, quality) in counts.items()),
        T.noted(T.or_unknown(X.group_digits(F.col("display"))), T.rule_words(rule), by=" ").alias("total"),
        T.noted(T.or_unknown(X.format_money(F.col("amount_minor"), F.col("exponent"), F.col("currency"), 4)), F.when(priced, T.cost_note(F.col("cost_status"), F.col("pricing_version"))), by=" ").alias("cost"),
        T.or_unknown(X.provider_of(F.col("model"))).alias("provider"),
        T.or_unknown(F.col("project")).alias("project"),
        T.or_unknown(F.col("session_id")).alias("session"),
        T.timestamp_note(F.col("timestamp_interpretation")).alias("logged_note"),
    )


def health_rows(health: DataFrame, capabilities: DataFrame, now: datetime) -> DataFrame:
    """The newest health of each source (of `state.health_history`) in words; a failure's text only while it lasts."""
    t = at(now)
    newest = health.groupBy("source_app").agg(F.max_by(F.struct(*[c for c in health.columns if c != "source_app"]), "seq").alias("h")).select("source_app", "h.*")
    h = newest.join(capabilities.select("source_app", "needs_network"), "source_app", "left")
    state, waiting, synced, seen, error = (F.col(c) for c in ("state", "awaiting_upstream", "app_synced_at", "source_observed_at", "last_error"))
    retried = F.when(F.coalesce("needs_network", F.lit(False)) & (state == "offline"), " · retrying with backoff").otherwise("")
    return h.select(
        "source_app",
        named(F.col("source_app"), SOURCE_LABELS).alias("label"),
        T.sync_word(state, waiting).alias("word"),
        T.text("app synced ", T.ago(synced, t)).alias("synced"),
        T.text("source reported ", T.ago(seen, t)).alias("reported"),
        F.when(state.isin("offline", "error"), T.text(error, retried)).alias("failure"),
        T.freshness(state, waiting, synced, seen, error, t).alias("freshness"),
    )


def menu_rows(quotas: DataFrame, records: DataFrame) -> DataFrame:
    """The lines of a menu in their order: allowances by source and window, all tokens, the first currency's cost, sources."""
    line = lambda block, order, id_, text: F.struct(F.lit(block).alias("block"), order.alias("rank"), id_.alias("id"), text.alias("text"))
    order = lambda *c: F.struct(*(x.alias(f"o{k}") for k, x in enumerate((*c, F.lit("")) if len(c) < 3 else c)))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source_app"))
    tag = F.when(F.col("source_app") == "claude_code", "claude").otherwise(F.col("source_app"))
    when = F.coalesce(T.text("resets ", F.date_format("resets_at", "MMM d, h:mma")), F.lit(MENU_WORDS["idle"]))
    left = T.text(tag, F.coalesce(T.text(" ", F.lower("label")), F.lit("")), " · ", X.round_tenths(F.greatest(F.lit(0), 1000 - F.col("used"))), MENU_WORDS["left"], T.menu_window(F.col("window_minutes")), MENU_WORDS["of"], when)
    q = pooled(quotas).select(line(0, order(rank.cast("long"), F.col("window_minutes").cast("long"), F.col("pool")), F.concat_ws(":", F.lit("quota"), "source_app", F.col("window_minutes").cast("string"), "pool"), left).alias("l"))
    zero = F.lit(0).cast("long")
    whole = ledger.totals(records).select(line(1, order(zero, zero), F.lit("total"), T.text(X.group_digits(F.col("display")), MENU_WORDS["tokens"])).alias("l"))
    first = ledger.cost_by_currency(records).agg(F.min(F.struct("currency", "amount_minor", "exponent")).alias("c")).filter("c is not null")
    cost = first.select(line(2, order(zero, zero), F.lit("cost"), X.format_money(F.col("c.amount_minor"), F.col("c.exponent"), F.col("c.currency"))).alias("l"))
    groups = ledger.totals(records, "source_app")
    sources = groups.select(line(3, order(-F.col("display"), zero, named(F.col("source_app"), SOURCE_LABELS)), T.text("source:", F.col("source_app")), T.text(named(F.col("source_app"), SOURCE_LABELS), "  ", X.group_digits(F.col("display")))).alias("l"))
    lines = q.unionByName(whole).unionByName(cost).unionByName(sources).select("l.*")
    return lines.select((F.row_number().over(Window.orderBy("block", "rank", "id")) - 1).alias("position"), "id", "text")  # as many as there are allowances and sources


@dataclass(frozen=True)
class Risk:
    """What a risk view asks for at once: live allowances, fits, projections and paces."""

    quotas: DataFrame
    fits: DataFrame
    projections: DataFrame
    paced: DataFrame


def risk(samples: DataFrame, records: DataFrame, seen_until: datetime, now: datetime, save: Callable[[DataFrame, str], DataFrame]) -> Risk:
    """Allowances live at `now` by the readings up to `seen_until`, with all that is derived from them.

    `save` writes a frame and reads it back: readings and fits are used several times. `records` should be narrow and
    written already, as they are read for each of burn, baseline, duty, spans and projection.
    """
    history = records.filter(F.col("event_ts") <= at(now))
    seen = save(samples.filter(F.col("observed_at") <= at(seen_until)), "samples")
    quotas = series.live_quotas(seen, seen_until, now)
    fits = save(series.calibration(seen, history), "fits")
    ahead = save(series.projection(quotas, fits, history, now), "projections")
    return Risk(quotas, fits, ahead, series.pace(series.projected(quotas, ahead, now), seen, history, now))


@dataclass(frozen=True)
class Snapshot:
    """What a dashboard asks for at once, all of one revision of the records. Nothing is computed until a frame is used."""

    revision: int
    overview: DataFrame
    summary: DataFrame
    threads: DataFrame
    recent: DataFrame
    count: DataFrame
    quotas: DataFrame | None = None
    health: DataFrame | None = None


def snapshot(records: DataFrame, revision: int, overview: ledger.Filter, shown: ledger.Filter, limit: int | None = None) -> Snapshot:
    """The overview by its own filter, which no choice of source narrows, and everything else by the filter of what is shown.

    `records` are those of `revision` (`Ledger.current(before=revision + 1)`), so the frames agree while commits go on.
    """
    some = shown.apply(records)
    return Snapshot(revision, ledger.totals_all_levels(overview.apply(records)), ledger.totals_all_levels(some), thread_list(some), ledger.recent(some, limit), records.agg(F.count("*").alias("records")))


def snapshot_at(state: State, overview: ledger.Filter, shown: ledger.Filter, limit: int | None = None) -> Snapshot:
    """The snapshot of one commit of a ledger: records, allowances and health all come from its manifest.

    Totals and count are folded from the sums that the commits keep, so they read no record; their date bounds must be whole
    hours. Threads and the recent list need the records' own times.
    """
    records = state.records().withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    levels = lambda wanted: _levels(state, wanted)
    some = shown.apply(records.withColumn("event_id", F.col("id")))
    return Snapshot(state.revision, levels(overview), levels(shown), thread_list(some), ledger.recent(some, limit), state.totals().select("records"), state.quotas(), state.health())


def _levels(state: State, wanted: ledger.Filter) -> DataFrame:
    none = lambda c: F.lit(None).cast("string").alias(c)
    whole = state.totals(wanted=wanted).select(none("source_app"), none("model"), F.lit("all").alias("level"), "*")
    return whole.unionByName(_level(state, wanted, "source_app", "source")).unionByName(_level(state, wanted, "model", "model"))


def _level(state: State, wanted: ledger.Filter, by: str, level: str) -> DataFrame:
    totals = state.totals(by, wanted=wanted)
    other = "model" if by == "source_app" else "source_app"
    return totals.withColumns({other: F.lit(None).cast("string"), "level": F.lit(level)})
