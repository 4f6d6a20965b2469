"""Scalar functions over columns: cleaning, identities, timestamps, money, minutes and wording. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COST_STATUSES, COUNTABLE, FLOOR_MIN, INSTANCE_TOLERANCE_US, MAX_EXPONENT, QUALITIES, WINDOW_NAMES, named

SEPARATOR = "\x1f"


def div(a: Column, b: Column | int) -> Column:
    """Integer division toward zero; null where the divisor is zero."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def clean(c: Column) -> Column:
    """Unicode white space off both ends; blank is null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def trimmed(c: Column) -> Column:
    """Unicode white space off both ends, nulls empty."""
    return F.coalesce(clean(c), F.lit(""))


def packed(text: Column) -> Column:
    """A string as bytes, half as many where it is lowercase hex, as hashes are; the first byte tells which."""
    raw = F.unhex(text)
    return F.when(F.lower(F.hex(raw)) == text, F.concat(F.lit(bytearray(b"\0")), raw)).otherwise(F.concat(F.lit(bytearray(b"\1")), text.cast("binary")))


def unpacked(value: Column) -> Column:
    """The string of `packed`."""
    rest = F.substr(value, F.lit(2))
    return F.when(F.substr(value, F.lit(1), F.lit(1)) == F.lit(bytearray(b"\0")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def dedupe_key(source: Column, event_id: Column, *content: Column) -> Column:
    """Identity by the source's own event id, else by content, trimmed."""
    own = clean(event_id)
    return F.when(own.isNotNull(), joined_hash(F.lit("v1"), source, F.lit("event"), own)).otherwise(joined_hash(F.lit("v1"), source, F.lit("content"), *(trimmed(c.cast("string")) for c in content)))


def content_hash(raw_timestamp: Column, provider: Column, model: Column, counts: list[tuple[Column, Column]], reported: Column, project: Column, session: Column, cost: tuple[Column, Column, Column, Column, Column]) -> Column:
    """What a correction may change: instant, provider, model, each count with its quality, total, project, session, cost.

    `counts`: value and quality of input, output, cached input and reasoning; `cost`: status, pricing version, minor
    units, currency and exponent. Without a status there is no cost, which is one empty part.
    """
    status, pricing, minor, currency, exponent = cost
    amount = F.when(minor.isNotNull(), F.concat_ws("/", minor.cast("string"), currency, exponent.cast("string")))
    priced = F.when(status.isNull(), "").otherwise(F.concat_ws(SEPARATOR, named(status, COST_STATUSES), trimmed(pricing), F.coalesce(amount, F.lit(""))))
    each = [x for value, quality in counts for x in (value, named(F.coalesce(quality, F.when(value.isNotNull(), "exact").otherwise("unknown")), QUALITIES))]
    return joined_hash(F.lit("v1"), trimmed(raw_timestamp), trimmed(provider), trimmed(model), *each, reported, trimmed(project), trimmed(session), priced)


def cost_problem(status: Column, pricing: Column, minor: Column, currency: Column, exponent: Column) -> Column:
    """Why a draft's cost can't be taken, or null: currency of three letters, exponent of 0 to 6, status that fits."""
    shape = minor.isNotNull() & ~F.coalesce(currency.rlike("^[A-Za-z]{3}$") & exponent.between(0, MAX_EXPONENT), F.lit(False))
    return F.when(shape, "invalid cost").when((status == "computed_from_pricing") & clean(pricing).isNull(), "missing pricing version").when((status == "not_available") & minor.isNotNull(), "contradictory cost status")


def record_id(source: Column, key: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(key, 1, 16))


def countable(value: Column, quality: Column) -> Column:
    return F.when(quality.isin(*COUNTABLE), value)


def display_total(reported: Column, given: Column, output: Column, reasoning: Column) -> Column:
    """The source's own total, else input + output + reasoning; null if neither input nor output is known."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.coalesce(reported, F.when(given.isNotNull() | output.isNotNull(), zero(given) + zero(output) + zero(reasoning)))


def total_rule(reported: Column, given: Column, output: Column, reasoning: Column) -> Column:
    return (
        F.when(reported.isNotNull(), "source_reported")
        .when(given.isNull() & output.isNull(), "unknown")
        .when(reasoning.isNotNull(), "input_output_reasoning")
        .otherwise("input_output")
    )


#: Without an offset, fields may have one digit; with one, they have two.
_NAIVE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?$"
_ZONED = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})$"
_EPOCH = r"^-?\d{1,19}$"


def timestamp_kind(raw: Column) -> Column:
    """How a source's timestamp is read: missing, explicit_offset (epoch digits too), assumed_utc or unparsable."""
    s = clean(raw)
    return (
        F.when(s.isNull(), "missing")
        .when(s.rlike(_EPOCH) & s.try_cast("long").isNotNull(), "explicit_offset")
        .when(s.rlike(_ZONED) & F.try_to_timestamp(s).isNotNull(), "explicit_offset")
        .when(s.rlike(_NAIVE) & F.try_to_timestamp(s).isNotNull(), "assumed_utc")
        .otherwise("unparsable")
    )


def is_resolved(kind: Column) -> Column:
    return ~kind.isin("unparsable", "missing")


def parse_timestamp(raw: Column) -> Column:
    """A UTC timestamp; epoch digits are seconds, milli-, micro- or nanoseconds by their number. The session is in UTC."""
    s = clean(raw)
    n, digits = F.when(s.rlike(_EPOCH), s.try_cast("long")), F.length(F.regexp_replace(s, "^-", ""))
    micros = F.when(digits <= 11, n * 1_000_000).when(digits <= 13, n * 1000).when(digits <= 16, n).otherwise(F.floor(n / 1000).cast("long"))
    return F.when(n.isNotNull(), F.timestamp_micros(micros)).when(is_resolved(timestamp_kind(raw)), F.try_to_timestamp(s))


def line_timestamp(line: Column) -> Column:
    """The first timestamp that a line of JSON names, from its text alone; null where it isn't one with an offset."""
    raw = F.regexp_extract(line, '"timestamp":"([^"]*)"', 1)
    return F.when(raw.rlike(_ZONED), F.try_to_timestamp(raw))


def same_instance(a: Column, b: Column) -> Column:
    """One allowance window: both without a reset, or resets at most two minutes apart."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(micros(a) - micros(b)) <= INSTANCE_TOLERANCE_US, F.lit(False))


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def minutes_floor(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((micros(then) - micros(now)) / 60_000_000).cast("long"))


def minutes_ceil(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.floor((micros(then) - micros(now)) / 1_000_000) / 60).cast("long"))


def minutes_round(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0), F.round((micros(then) - micros(now)) / 60_000_000).cast("long"))


def staleness_limit(window: Column) -> Column:
    return F.greatest(div(window, 10), F.lit(FLOOR_MIN))


def percent_to_tenths(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p) | (p <= 0) | (p == float("inf")), 0).otherwise(F.least(F.lit(1000), F.round(p * 10).cast("int")))


def cents_to_minor(cents: Column) -> Column:
    """Hundredths of a cent; negative and non-finite amounts are null."""
    return F.when((cents >= 0) & ~F.isnan(cents) & (cents < float("inf")), F.round(cents * 100).cast("long"))


def project_name(path: Column) -> Column:
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def provider_of(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("claude"), "anthropic").when(m.contains("gemini"), "google").when(m.contains("gpt") | m.startswith("o"), "openai").when(m.contains("composer") | m.contains("grok"), "cursor")


def format_tenths(t: Column) -> Column:
    return F.concat(div(t, 10).cast("string"), F.when(t % 10 != 0, F.concat(F.lit("."), (t % 10).cast("string"))).otherwise(""), F.lit("%"))


def round_tenths(t: Column) -> Column:
    """Whole percent, half up."""
    return div(t + 5, 10)


def compact_duration(m: Column) -> Column:
    """Minutes as 45m, 7h or 3d, hours and days rounded half up."""
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m"))).when(m < 2880, F.concat(div(m + 30, 60).cast("string"), F.lit("h"))).otherwise(F.concat(div(m + 720, 1440).cast("string"), F.lit("d")))


def window_name(minutes: Column) -> Column:
    return named(minutes, WINDOW_NAMES, F.lit("this window"))


def group_digits(n: Column) -> Column:
    return F.format_number(n, 0)


def even_pace_percent(until_reset: Column, window: Column) -> Column:
    """How much of a window has gone by, in percent: what an even pace would have used. Null before any of it has."""
    gone = window - until_reset
    return F.when((window > 0) & (gone > 0), F.least(F.lit(100.0), gone / window * 100))


def thread_name(project: Column, session: Column) -> Column:
    return F.coalesce(clean(project), F.concat(F.lit("thread "), F.substring(session, 1, 6)))


def format_money(minor: Column, exponent: Column, currency: Column, digits: int = 2) -> Column:
    """So many decimals, half up, from integers alone, thousands parted."""
    scale, step = F.pow(F.lit(10), exponent).cast("decimal(38,0)"), 10**digits
    scaled = div(F.abs(minor).cast("decimal(38,0)") * step + div(scale, 2), scale)
    fraction = F.concat(F.lit("."), F.lpad((scaled % step).cast("long").cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.format_number(div(scaled, step).cast("decimal(38,0)"), 0), fraction, F.lit(" "), currency)
