"""What a screen says of totals, clocks, windows, pace and health, as columns; null where nothing needs to be said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BASELINE_WORDS, BASIS_WORDS, DAY_MINUTES, MENU_WINDOWS, NOTES, QUALITY_NOTES, RULE_WORDS, SOURCE_LABELS, SYNC_WORDS, TIMESTAMP_NOTES, TRAILING_WORDS, WEEK_MINUTES, WINDOW_WORDS, named
from .scalars import clean, div, even_pace_percent, format_tenths, group_digits, micros

UNKNOWN = "—"


def text(*parts: Column | str) -> Column:
    """One string of columns and words; null if a part is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def noted(*parts: Column, by: str = " · ") -> Column:
    """The parts that there are, or null."""
    return F.nullif(F.concat_ws(by, *parts), F.lit(""))


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(UNKNOWN))


def counted(n: Column, one: str, many: str, rest: str) -> Column:
    """Of a count above 0: the count, its noun and what is said of it."""
    return F.when(n > 0, text(group_digits(n), " ", F.when(n == 1, one).otherwise(many), rest))


def total_gaps(unknown: Column) -> Column:
    return counted(unknown, "record", "records", " did not report this")


def cost_gaps(without: Column) -> Column:
    return counted(without, "record", "records", " reported no cost")


def share_percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 of nothing."""
    part, whole = part.cast("decimal(30,0)"), whole.cast("decimal(30,0)")
    return F.when(whole > 0, div(part * 200 + whole, whole * 2)).otherwise(0).cast("long")


def day_span(first: Column, last: Column) -> Column:
    """The days from first to last; one of them may be missing."""
    day = lambda c: F.date_format(c, "MMM d")
    a, b = day(F.coalesce(first, last)), day(F.coalesce(last, first))
    return F.when(a == b, a).otherwise(text(a, " – ", b))


def ago(then: Column, now: Column) -> Column:
    """How long ago, in one unit; a time to come is just now."""
    s = F.floor((micros(now) - micros(then)) / 1_000_000).cast("long")
    unit = F.when(s < 60, text(s, "s")).when(s < 3600, text(div(s, 60), "m")).when(s < 86_400, text(div(s, 3600), "h")).otherwise(text(div(s, 86_400), "d"))
    return F.when(then.isNull(), "never").when(s < 10, "just now").otherwise(text(unit, " ago"))


def runway_text(minutes: Column) -> Column:
    """A length of use as 25m, 1h 40m or 2d 3h."""
    hours, rest = div(minutes, 60), minutes % 60
    pair = lambda a, x, b, y: text(a, x, F.when(b > 0, text(" ", b, y)).otherwise(""))
    long_ = F.when(hours < 24, pair(hours, "h", rest, "m")).otherwise(pair(div(hours, 24), "d", hours % 24, "h"))
    return F.when(minutes.isNull(), UNKNOWN).when(minutes < 1, "<1m").when(minutes < 60, text(minutes, "m")).otherwise(long_)


def window_words(minutes: Column) -> Column:
    days = (minutes > DAY_MINUTES) & (minutes % DAY_MINUTES == 0)
    other = F.when(days, text("this ", div(minutes, DAY_MINUTES), "d period")).when(minutes % 60 == 0, text("this ", div(minutes, 60), "h window")).otherwise(text("this ", minutes, "min window"))
    return named(minutes, WINDOW_WORDS, other)


def window_tag(minutes: Column) -> Column:
    days = (minutes > DAY_MINUTES) & (minutes % DAY_MINUTES == 0)
    other = F.when(days, text(div(minutes, DAY_MINUTES), "d")).when(minutes % 60 == 0, text(div(minutes, 60), "h")).otherwise(text(minutes, "min"))
    return named(minutes, {WEEK_MINUTES: "week", DAY_MINUTES: "day"}, other)


def pool_name(label: Column, source: Column, window: Column) -> Column:
    """A pool by its label, in which its source's name gives way to "own"; without one by its window."""
    low, of = F.lower(label), named(source, SOURCE_LABELS)
    return F.when(label.isNull(), window_tag(window)).when(F.startswith(low, text(of, " ")), text("own ", F.substr(low, F.length(of) + 2))).otherwise(low)


def reset_text(resets_at: Column, now: Column) -> Column:
    """When a window resets: the clock alone where that is today."""
    clock = F.date_format(resets_at, "HH:mm")
    return F.when(resets_at.isNull(), "not started").when(F.to_date(resets_at) == F.to_date(now), text("resets ", clock)).otherwise(text("resets ", F.date_format(resets_at, "MMM d"), " ", clock))


def even_pace_note(until_reset: Column, window: Column) -> Column:
    return text(NOTES["even"], F.round(even_pace_percent(until_reset, window)).cast("long"), NOTES["by_now"])


def pace_sentence(state: Column, runway: Column, shortfall: Column) -> Column:
    left = text(runway_text(runway), NOTES["left"])
    return (
        F.when(state == "green", F.when(runway.isNull(), NOTES["nothing"]).otherwise(text(left, NOTES["inside"])))
        .when(state == "amber", text(left, NOTES["edge"]))
        .when(state == "red", text(NOTES["runs_out"], runway_text(shortfall), NOTES["early"]))
        .otherwise(named(state, {"notStarted": NOTES["untouched"], "exhausted": NOTES["used_up"], "unknown": NOTES["too_early"]}))
    )


def pace_compact(state: Column, runway: Column) -> Column:
    """The verdict in few words; null where the reset already says it."""
    return F.when(state == "red", text(NOTES["out_in"], runway_text(runway))).when(state == "green", F.when(runway.isNull(), NOTES["idle"]).otherwise(NOTES["on_track"])).otherwise(named(state, {"amber": NOTES["at_edge"], "exhausted": NOTES["used"]}))


def pace_gap(state: Column, shortfall: Column) -> Column:
    return F.when((state == "red") & shortfall.isNotNull(), text(runway_text(shortfall), NOTES["short"]))


def basis_note(basis: Column, minutes: Column) -> Column:
    """What a pace was measured over."""
    return F.when(basis == "trailing", text(TRAILING_WORDS[0], minutes, TRAILING_WORDS[1])).otherwise(named(basis, BASIS_WORDS))


def menu_window(minutes: Column) -> Column:
    days = (minutes > DAY_MINUTES) & (minutes % DAY_MINUTES == 0)
    other = F.when(days, text(div(minutes, DAY_MINUTES), "d period")).when(minutes % 60 == 0, text(div(minutes, 60), "h window")).otherwise(text(minutes, "min window"))
    return named(minutes, MENU_WINDOWS, other)


def vs_baseline_note(vs: Column) -> Column:
    return named(vs, BASELINE_WORDS)


def reading_note(aged: Column, observed_at: Column, now: Column) -> Column:
    return F.when(aged, text(NOTES["reading"], ago(observed_at, now), NOTES["optimistic"]))


def projection_note(confirmed: Column, observed_at: Column, added: Column, provisional: Column, n_spans: Column, residual: Column, now: Column) -> Column:
    """Where a projected figure comes from: the confirmed part, what was added, and how good the rate is."""
    rate = F.when(provisional, NOTES["single"]).otherwise(text(NOTES["fitted"], n_spans, NOTES["within"], residual, "%"))
    return noted(text(format_tenths(confirmed), NOTES["confirmed"], ago(observed_at, now)), text("+", format_tenths(added), NOTES["estimated"]), rate, by="\n")


def sync_word(state: Column, awaiting: Column) -> Column:
    return F.when((state == "current") & awaiting, NOTES["billing"]).otherwise(named(state, SYNC_WORDS))


def freshness(state: Column, awaiting: Column, synced: Column, observed: Column, error: Column, now: Column) -> Column:
    """Both clocks of a source, as they answer different questions, then what is awaited and what failed."""
    return noted(sync_word(state, awaiting), text(NOTES["synced"], ago(synced, now)), text(NOTES["reported"], ago(observed, now)), F.when(awaiting, NOTES["awaiting"]), text(NOTES["last_error"], error))


def timestamp_note(kind: Column) -> Column:
    return named(kind, TIMESTAMP_NOTES)


def quality_note(quality: Column) -> Column:
    return named(quality, QUALITY_NOTES)


def rule_words(rule: Column) -> Column:
    return named(rule, RULE_WORDS)


def cost_note(status: Column, pricing: Column) -> Column:
    return F.when(status == "reported_by_source", NOTES["by_source"]).when(status.isNotNull(), text(NOTES["priced"], or_unknown(clean(pricing))))
