"""Schemas, enum orders and constants of the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds that decide results.
INSTANCE_TOLERANCE_US = 120_000_000
QUANTUM_TENTHS = 20
MIN_HORIZON_MIN = 10
DUTY_LIMIT_MIN, DUTY_UNLOCK = 1440, 80
FLOOR_MIN = 15
RATE_SCALE = 10**12
MIN_SPANS, BOOTSTRAP_TENTHS, MAX_RESIDUAL, MAX_PROJECTION_MIN = 3, 50, 35, 120
MODEL_WEIGHTS = {"opus": (1500, 7500, 30), "haiku": (100, 500, 2), None: (300, 1500, 6)}
BASELINE_DAYS, SLOT_DAYS, ACTIVE_HOURS = 30, 3, 24
LIMIT_DEFAULT, LIMIT_MAX = 50, 500
SESSION_MINUTES = 300
MAX_EXPONENT = 6
BIGINT_MAX = 9223372036854775807
SOURCES = ("cursor", "claude_code", "codex")
COUNTABLE = ("exact", "estimated", "partial")

QUALITIES = {"exact": "Exact", "estimated": "Estimated", "partial": "Partial", "unknown": "Unknown"}
COST_STATUSES = {"reported_by_source": "ReportedBySource", "computed_from_pricing": "ComputedFromPricing", "not_available": "NotAvailable"}
METRICS = {"remaining_percent": "RemainingPercent", "minutes_until_reset": "MinutesUntilReset", "projected_exhaustion": "ProjectedExhaustion"}
SOURCE_TITLES = {"cursor": "Cursor", "claude_code": "Claude", "codex": "Codex"}
WINDOW_NAMES = {300: "this session", 10_080: "this week"}

# The words of the screen.
DAY_MINUTES, WEEK_MINUTES, MONTH_MINUTES = 1440, 10_080, 43_200
SOURCE_LABELS = {"cursor": "cursor", "claude_code": "claude code", "codex": "codex"}
WINDOW_WORDS = {300: "this session", 10_080: "this week", 1440: "today"}
SYNC_WORDS = {"syncing": "syncing", "current": "watching", "stale": "stale", "offline": "offline", "error": "error", "unknown": "not checked"}
BASELINE_WORDS = {"above": "heavier than your usual right now", "farAbove": "far heavier than your usual right now", "below": "lighter than your usual right now"}
BASIS_WORDS = {"window_open": "averaged since the window opened"}
TRAILING_WORDS = ("measured over the last ", "m")
MENU_WINDOWS = {300: "session", 10_080: "week", 1440: "day"}
MENU_WORDS = {"left": "% of the ", "of": " left · ", "idle": "not started", "tokens": " tokens"}
NOTES = {
    "left": " of usage left · ",
    "inside": "comfortably inside the window",
    "edge": "right at the edge of the window",
    "nothing": "nothing being spent",
    "runs_out": "runs out ",
    "early": " early at this pace",
    "untouched": "allowance untouched",
    "used_up": "allowance used up",
    "too_early": "too early to say",
    "out_in": "out in ",
    "idle": "idle",
    "on_track": "on track",
    "at_edge": "at the edge",
    "used": "used up",
    "short": " short",
    "reading": "from a reading ",
    "optimistic": "; nothing spent since, so it can only be optimistic",
    "single": "rate from a single reading so far, not yet corroborated",
    "fitted": "rate fitted from ",
    "within": " readings, typically within ±",
    "confirmed": " confirmed ",
    "estimated": " estimated from usage since",
    "even": "even pace would be ",
    "by_now": "% used by now",
    "awaiting": "activity detected; awaiting billing data",
    "billing": "awaiting billing",
    "synced": "app synced ",
    "reported": "source reported ",
    "last_error": "last error: ",
    "by_source": "reported by the source",
    "priced": "priced locally · ",
}
TIMESTAMP_NOTES = {
    "assumed_utc": "no timezone in the log; read as UTC",
    "assumed_local": "no timezone in the log; read as local time",
    "unparsable": "the log's timestamp could not be read",
    "missing": "the log recorded no timestamp",
}
QUALITY_NOTES = {"estimated": "estimated by the source", "partial": "the source reported only part of this", "unknown": "not reported"}
RULE_WORDS = {"source_reported": "total reported by the source", "input_output": "input + output", "input_output_reasoning": "input + output + reasoning"}

DRAFT = (
    "source_app string, source_event_id string, raw_timestamp string, provider string, model string, "
    "input long, output long, cached_input long, reasoning long, reported_total long, project string, session_id string, source_ref string, "
    "input_quality string, output_quality string, cached_input_quality string, reasoning_quality string, "
    "cost_status string, pricing_version string, amount_minor long, currency string, exponent int, "
    "adapter string, origin string, position long"
)
#: Where a draft stands in its source: a file or page, and a line or byte in it. Of drafts of one key the last counts.
ORDER = ("origin", "position")
HEALTH = "source_app string, state string, last_attempt_at timestamp, app_synced_at timestamp, source_observed_at timestamp, last_error string, awaiting_upstream boolean"
CHECKPOINT = "adapter string, unit string, payload string"
QUOTA = "source_app string, label string, window_minutes int, used_tenths int, resets_at timestamp, observed_at timestamp"


def source_rank(c: Column) -> Column:
    """The enum order of sources, which isn't the order of their names."""
    return F.array_position(F.array(*map(F.lit, SOURCES)), c)


def named(c: Column, names: dict, other: Column | None = None) -> Column:
    """The value of a fixed table for each key."""
    out = F.lit(None) if other is None else other
    for key, value in reversed(names.items()):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out
