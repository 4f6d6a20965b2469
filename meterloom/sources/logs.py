"""Readers of the three kinds of raw session logs: JSON lines to drafts, malformed lines skipped.

Readers take a folder or glob. Those named after drafts return the columns of `schema.DRAFT`, those of allowances the
columns of `schema.QUOTA`; `bubbles` and `billed_events` are steps on the way. Lines of one file keep their order by a
number that is assigned while the file's lines are read, so state is carried by windows over (file, line).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean, cents_to_minor, joined_hash, line_timestamp, minutes_floor, parse_timestamp, percent_to_tenths, project_name, provider_of
from ..operators.conversations import turn_drafts
from ..operators.series import tiled_sessions
from ..schema import CHECKPOINT, DRAFT, MONTH_MINUTES, QUOTA, SESSION_MINUTES

_ROLLOUT = "timestamp string, type string, payload struct<id:string,cwd:string,model_provider:string,model:string,type:string,info:struct<last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint>>,rate_limits:struct<primary:struct<used_percent:double,window_minutes:int,resets_at:bigint>>>"
_TRANSCRIPT = "timestamp string, uuid string, sessionId string, cwd string, type string, message struct<id:string,model:string,usage:struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint>>"
_BUBBLE = "conversationId string, bubbleId string, type int, createdAt string, model string, inputTokens bigint, outputTokens bigint, usageUuid string, requestId string"
_CARRIED = "own string, provider string, model string, turn_cwd string, meta_cwd string, counted long"
#: How many files a look at what goes on right now reads.
FRESHEST = 10
#: Names of adapters, under which records are replaced and checkpoints kept.
ROLLOUTS, TRANSCRIPTS, BILLED, BUBBLES, LIVE_REF = "rollouts", "transcripts", "billed", "bubbles", "local-activity"
_TYPES = dict(c.strip().split(" ") for c in DRAFT.split(","))


def freshest(spark: SparkSession, path: str, glob: str, n: int = FRESHEST, since: datetime | None = None) -> list[str]:
    """The `n` files changed last, of those changed at `since` or later; none of them is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "modificationTime")
    if since is not None:
        files = files.filter(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    return [r["path"] for r in files.orderBy(F.desc("modificationTime"), "path").limit(n).collect()]


def lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(path, line_no, value) of every line of the matching files; a file is one row until its lines are parted, so a single log
    must stay below 2 GB."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    numbered = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return numbered.filter(F.length("value") > 0)


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("j", F.from_json("value", schema)).filter("j is not null").drop("value")


def _draft(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in _TYPES.items()))


def sum_known(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _rollouts(spark: SparkSession, path: str) -> DataFrame:
    return _rollout_lines(lines(spark, path, "rollout-*.jsonl"))


def _rollout_lines(raw: DataFrame) -> DataFrame:
    some = raw.filter(F.col("value").rlike("session_meta|turn_context|token_count"))
    stem = F.regexp_extract("path", r"rollout-.+-(.{36})\.jsonl$", 1)
    return _parsed(some, _ROLLOUT).withColumn("rollout", F.coalesce(F.nullif(stem, F.lit("")), F.col("path")))


def rollout_drafts(spark: SparkSession, path: str) -> DataFrame:
    return rollouts(lines(spark, path, "rollout-*.jsonl"), spark.createDataFrame([], CHECKPOINT))[0]


def rollouts(raw: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lines (path, line_no, value) one draft per token count, and checkpoints of how far each rollout has come.

    Rollout id, provider, model and folder are carried from the lines before, from `held` where these came in an earlier
    batch. A turn's folder overrides; a session's fills in only while there is none. A rollout whose first line comes again
    has been written anew and goes on from nothing.
    """
    p = lambda c: F.col(f"j.payload.{c}")
    meta, turn = F.col("j.type") == "session_meta", F.col("j.type") == "turn_context"
    counted = F.coalesce((F.col("j.type") == "event_msg") & (p("type") == "token_count") & p("info.last_token_usage").isNotNull(), F.lit(False))
    fresh = raw.groupBy("path").agg(F.min("line_no").alias("least")).filter("least = 0").select("path")
    told = {"own": F.when(meta, p("id")), "provider": F.when(meta, p("model_provider")), "model": F.when(turn, p("model")), "turn_cwd": F.when(turn, p("cwd")), "meta_cwd": F.when(meta, p("cwd"))}
    rows = _rollout_lines(raw).withColumns(told | {"counted": counted.cast("long")})
    before = held.filter(F.col("adapter") == ROLLOUTS).select(F.col("unit").alias("rollout"), F.from_json("payload", _CARRIED).alias("c")).select("rollout", "c.*")
    # what was carried so far stands before the first line
    before = before.join(rows.select("rollout", "path").distinct().join(fresh, "path", "left_anti"), "rollout").withColumn("line_no", F.lit(-1))
    both = rows.unionByName(before, allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    carried = both.withColumns({c: last(c) for c in ("own", "provider", "model", "turn_cwd")} | {"meta_cwd": F.first("meta_cwd", ignorenulls=True).over(w), "nth": F.sum("counted").over(w) - 1})
    names = ("own", "provider", "model", "turn_cwd", "meta_cwd")
    reached = carried.groupBy("rollout").agg(F.max_by(F.struct(*names), F.struct("line_no", "path")).alias("c"), (F.max("nth") + 1).alias("counted"))
    checkpoints = reached.select(F.lit(ROLLOUTS).alias("adapter"), F.col("rollout").alias("unit"), F.to_json(F.struct("c.*", "counted")).alias("payload"))
    used = carried.filter("line_no >= 0 and counted = 1").withColumns({"own": F.coalesce("own", "rollout"), "cwd": F.coalesce("turn_cwd", "meta_cwd")})
    u = lambda c: p(f"info.last_token_usage.{c}")
    drafts = _draft(
        used, source_app=F.lit("codex"), source_event_id=F.concat_ws(":", "own", F.col("nth").cast("string")), raw_timestamp=F.col("j.timestamp"), provider=F.col("provider"), model=F.col("model"), input=u("input_tokens"),
        output=u("output_tokens"), cached_input=u("cached_input_tokens"), reasoning=u("reasoning_output_tokens"), reported_total=u("total_tokens"), project=project_name(F.col("cwd")), session_id=F.col("own"), source_ref=F.col("rollout"), adapter=F.lit(ROLLOUTS), origin=F.col("path"), position=F.col("line_no"),
    )
    return drafts, checkpoints


def rollout_quota(spark: SparkSession, path: str) -> DataFrame:
    """The newest reading of each allowance window in the rollouts; percentages outside 0 to 10,000 tenths are rejected."""
    q = F.col("j.payload.rate_limits.primary")
    tenths = F.round(q.used_percent * 10).cast("int")
    read = _rollouts(spark, path).filter(q.isNotNull() & tenths.between(0, 10_000)).select(F.lit("codex").alias("source_app"), q.window_minutes.alias("window_minutes"), tenths.alias("used_tenths"), F.timestamp_seconds(q.resets_at).alias("resets_at"), F.try_to_timestamp("j.timestamp").alias("observed_at"))
    newest = read.groupBy("source_app", "window_minutes").agg(*(F.max_by(c, "observed_at").alias(c) for c in ("used_tenths", "resets_at", "observed_at")))
    return _quota(newest, F.lit(None))


def _quota(df: DataFrame, label: Column) -> DataFrame:
    return df.select("source_app", label.cast("string").alias("label"), F.col("window_minutes").cast("int").alias("window_minutes"), F.col("used_tenths").cast("int").alias("used_tenths"), "resets_at", "observed_at")


def cached_quota(spark: SparkSession, path: str) -> DataFrame:
    """The allowances of a transcript source's cache files: four windows, those without a percentage left out.

    A null reset stays null; one that can't be read drops its window.
    """
    one = "struct<utilization:double,resets_at:string>"
    names = {"five_hour": (300, None), "seven_day": (10_080, None), "seven_day_opus": (10_080, "Opus"), "seven_day_sonnet": (10_080, "Sonnet")}
    cache = spark.read.option("multiLine", True).schema(f"cachedUsageUtilization struct<fetchedAtMs:bigint,utilization:struct<{','.join(f'{n}:{one}' for n in names)}>>").json(path).select("cachedUsageUtilization.*")
    window = lambda n, minutes, label: F.struct(F.lit(minutes).alias("window_minutes"), F.lit(label).cast("string").alias("label"), F.col(f"utilization.{n}").alias("u"))
    each = cache.select("fetchedAtMs", F.explode(F.array(*(window(n, *w) for n, w in names.items()))).alias("w")).filter("w.u.utilization is not null")
    reset = F.try_to_timestamp("w.u.resets_at")
    each = each.filter(F.col("w.u.resets_at").isNull() | reset.isNotNull())
    read = each.select(F.lit("claude_code").alias("source_app"), "w.window_minutes", F.col("w.label").alias("pool_label"), percent_to_tenths(F.col("w.u.utilization")).alias("used_tenths"), reset.alias("resets_at"), F.timestamp_millis("fetchedAtMs").alias("observed_at"))
    return _quota(read, F.col("pool_label"))


def period_quota(spark: SparkSession, path: str, observed_at: datetime) -> DataFrame:
    """The allowances of exported cycle-usage answers, bare or wrapped: one for each pool that has a percentage, else the total.

    The window is the cycle's length, a month where its start is missing or not before its end; an answer without an end
    that can be read has no allowance. Numbers may be written as strings.
    """
    body = "planUsage struct<autoPercentUsed:string,apiPercentUsed:string,totalPercentUsed:string>, billingCycleStart string, billingCycleEnd string"
    wrapped = f"struct<{body.replace(' struct', ':struct').replace(' string', ':string')}>"
    page = spark.read.option("multiLine", True).schema(f"{body}, result {wrapped}, usage {wrapped}, data {wrapped}").json(path)
    bare = F.struct("planUsage", "billingCycleStart", "billingCycleEnd")
    root = F.coalesce(F.when(F.col("planUsage").isNotNull(), bare), *(F.when(F.col(f"{n}.planUsage").isNotNull(), F.col(n)) for n in ("result", "usage", "data")))
    r = page.select(root.alias("r")).select("r.planUsage.*", parse_timestamp(F.col("r.billingCycleStart")).alias("start"), parse_timestamp(F.col("r.billingCycleEnd")).alias("resets_at")).filter("resets_at is not null")
    number = lambda c: F.col(c).try_cast("double")
    pool = lambda label, percent: F.struct(F.lit(label).alias("pool_label"), percent.alias("percent"))
    own, other = number("autoPercentUsed"), number("apiPercentUsed")
    whole = F.when(own.isNull() & other.isNull(), number("totalPercentUsed"))
    each = r.select("start", "resets_at", F.explode(F.array(pool("Cursor Models", own), pool("Other Models", other), pool("Total", whole))).alias("p")).filter("p.percent is not null")
    length = minutes_floor(F.col("start"), F.col("resets_at"))
    read = each.select(F.lit("cursor").alias("source_app"), F.when(length > 0, length).otherwise(MONTH_MINUTES).alias("window_minutes"), "p.pool_label", percent_to_tenths(F.col("p.percent")).alias("used_tenths"), "resets_at", F.lit(observed_at).cast("timestamp").alias("observed_at"))
    return _quota(read, F.col("pool_label"))


def limit_quota(spark: SparkSession, path: str, now: str) -> DataFrame:
    """The newest rate-limit line of the freshest transcripts as a used-up allowance, if it resets after `now` (in UTC).

    The text names a wall clock and a zone; a clock that isn't after the line's own time is of the next day.
    """
    text = F.array_join(F.transform("j.message.content", lambda c: c.text), " ")
    files = freshest(spark, path, "*.jsonl")
    if not files:
        return spark.createDataFrame([], QUOTA)
    raw = _parsed(lines(spark, files, "*.jsonl").filter(F.col("value").contains("rate_limit")), "timestamp string, error string, message struct<content:array<struct<type:string,text:string>>>")
    hit = raw.filter(F.col("j.error") == "rate_limit").select(F.try_to_timestamp("j.timestamp").alias("observed_at"), text.alias("text")).filter("observed_at is not null")
    pattern = r"hit your (session|weekly|week) limit.*resets (\d{1,2})(?::(\d{2}))?(am|pm) \(([^)]+)\)"
    part = lambda k: F.regexp_extract("text", pattern, k)
    hour = part(2).try_cast("int") % 12 + F.when(part(4) == "pm", 12).otherwise(0)
    day = F.to_date(F.from_utc_timestamp("observed_at", part(5)))
    local = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), hour, F.coalesce(part(3).try_cast("int"), F.lit(0)), F.lit(0)).cast("timestamp")
    same = F.to_utc_timestamp(local, part(5))
    reset = F.when(same > F.col("observed_at"), same).otherwise(F.to_utc_timestamp(local + F.expr("INTERVAL 1 DAY"), part(5)))
    read = hit.filter(part(2) != "").select(F.lit("claude_code").alias("source_app"), F.when(part(1) == "session", 300).otherwise(10_080).alias("window_minutes"), F.lit(1000).alias("used_tenths"), reset.alias("resets_at"), "observed_at")
    newest = read.groupBy("source_app").agg(F.max_by(F.struct("window_minutes", "used_tenths", "resets_at", "observed_at"), "observed_at").alias("q")).select("source_app", "q.*")
    return _quota(newest.filter(F.col("resets_at") > F.lit(now).cast("timestamp")), F.lit(None))


def activity(spark: SparkSession, path: str, since: datetime) -> DataFrame:
    """The instants (t) at or after `since` that the lines of the freshest transcripts name first, read from their raw text."""
    files = freshest(spark, path, "*.jsonl", since=since)
    if not files:
        return spark.createDataFrame([], "t timestamp")
    return lines(spark, files, "*.jsonl").select(line_timestamp(F.col("value")).alias("t")).filter(F.col("t") >= F.lit(since).cast("timestamp"))


def allowances_at(spark: SparkSession, cache: str, transcripts: str, now: datetime) -> DataFrame:
    """What of a transcript source's allowances is live at `now` (UTC): cached windows that haven't reset, the session worked
    out from activity where its cached one has, and where nothing at all is live the last limit that was hit.

    A session window opens with the first message at or after the end of the one before. It is reported with nothing used,
    as seen when it opened; without an open one as idle. Transcripts are only read where the cache doesn't say enough.
    """
    cached = [r.asDict() for r in cached_quota(spark, cache).collect()]  # four windows at most
    instant = lambda t: t.replace(tzinfo=None)
    live = [q for q in cached if q["resets_at"] is None or instant(q["resets_at"]) > now]
    session = lambda q: q["window_minutes"] == SESSION_MINUTES and q["label"] is None
    expired = next((q for q in cached if session(q)), None)
    if not any(map(session, live)) and expired is not None:
        times = activity(spark, transcripts, instant(expired["resets_at"])).select(F.lit("session").alias("k"), F.col("t").cast("timestamp_ntz").alias("t"))
        tiled = tiled_sessions(times, "k", now).collect()  # one row, none without activity
        idle = {"source_app": "claude_code", "label": None, "window_minutes": SESSION_MINUTES, "used_tenths": 0, "resets_at": None}
        if not tiled:
            live.insert(0, idle | {"observed_at": expired["observed_at"]})
        elif tiled[0]["resets_at"] is None:
            live.insert(0, idle | {"observed_at": now})
        else:
            end = tiled[0]["resets_at"]
            live.insert(0, idle | {"resets_at": end, "observed_at": end - timedelta(minutes=SESSION_MINUTES)})
    if not live:
        return limit_quota(spark, transcripts, str(now))
    columns = [c.strip().split(" ")[0] for c in QUOTA.split(",")]
    return spark.createDataFrame([tuple(q[c] for c in columns) for q in live], QUOTA)


def transcript_drafts(spark: SparkSession, path: str) -> DataFrame:
    return transcripts(lines(spark, path, "*.jsonl"))


def transcripts(raw: DataFrame) -> DataFrame:
    """Of lines (path, line_no, value) the last snapshot of each message of a file; input includes what was written to the cache."""
    rows = _parsed(raw, _TRANSCRIPT).filter((F.col("j.type") == "assistant") & F.col("j.message.usage").isNotNull())
    rows = rows.withColumn("own", F.coalesce("j.message.id", "j.uuid", F.lit("")))
    last = rows.withColumn("at", F.row_number().over(Window.partitionBy("path", "own").orderBy(F.desc("line_no")))).filter("at = 1")
    u = lambda c: F.col(f"j.message.usage.{c}")
    return _draft(
        last, source_app=F.lit("claude_code"), source_event_id=F.col("own"), raw_timestamp=F.col("j.timestamp"), provider=F.lit("anthropic"), model=F.col("j.message.model"), input=sum_known(u("input_tokens"), u("cache_creation_input_tokens")),
        output=u("output_tokens"), cached_input=u("cache_read_input_tokens"), project=project_name(F.col("j.cwd")), session_id=F.col("j.sessionId"), source_ref=F.col("path"), adapter=F.lit(TRANSCRIPTS), origin=F.col("path"), position=F.col("line_no"),
    )


def bubbles(spark: SparkSession, path: str) -> DataFrame:
    """Exported bubbles in the columns that `conversations.turn_drafts` folds."""
    b = _parsed(lines(spark, path, "*.jsonl"), _BUBBLE).select("j.*").filter(F.col("type").isin(1, 2))
    tokens = F.coalesce("inputTokens", F.lit(0)) + F.coalesce("outputTokens", F.lit(0))
    # the clock is written as text or as milliseconds; conversations are ordered by the instant
    text = F.when(F.col("createdAt").rlike(r"^\d+$"), F.date_format(F.timestamp_millis(F.col("createdAt").try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.col("createdAt"))
    named_ids = (clean(F.col("usageUuid")).alias("usage_id"), clean(F.col("requestId")).alias("request_id"))
    return b.select(F.col("conversationId").alias("conversation"), text.alias("at"), F.col("bubbleId").alias("bubble"), (F.col("type") == 1).alias("is_user"), clean(F.col("model")).alias("model"), tokens.alias("tokens"), *named_ids, F.coalesce("inputTokens", F.lit(0)).alias("input"), F.coalesce("outputTokens", F.lit(0)).alias("output"))


def bubble_drafts(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """Exported bubbles as drafts: replies with tokens under their usage id, turns without any under their request id, else
    under the bubble's own. With `live` they are placeholders, which the billed feed replaces."""
    b = turn_drafts(bubbles(spark, path))
    paid = F.col("kind") == "tokens"
    own = F.coalesce(F.when(paid, F.col("usage_id")).otherwise(F.col("request_id")), F.col("bubble"))
    return _draft(
        b, source_app=F.lit("cursor"), source_event_id=own, raw_timestamp=F.col("at"), model=F.col("model"), input=F.when(paid, F.col("input")), output=F.when(paid, F.col("output")), session_id=F.col("conversation"),
        source_ref=F.lit(LIVE_REF) if live else F.lit("conversations"), adapter=F.lit(BUBBLES), origin=F.col("conversation"), position=F.lit(0),
    )


def billed_events(spark: SparkSession, path: str) -> DataFrame:
    """Billed events of exported pages: identity by the first id that is set, else by content, numbered among equals."""
    n = "tokenUsage struct<inputTokens:string,outputTokens:string,cacheWriteTokens:string,cacheReadTokens:string,totalCents:string>"
    page = spark.read.option("multiLine", True).schema(f"usageEventsDisplay array<struct<{'timestamp string, model string, kind string, kindLabel string, owningUser string, userEmail string, id string, eventId string, usageEventId string, requestId string, chargedCents string, '.replace(' string', ':string')}{n.replace('tokenUsage ', 'tokenUsage:')}>>").json(path)
    e = page.select(F.col("_metadata.file_path").alias("page"), F.posexplode("usageEventsDisplay").alias("place", "e")).select("page", "place", "e.*")
    own = F.coalesce(*(clean(F.col(c)) for c in ("id", "eventId", "usageEventId", "requestId")))
    e = e.withColumn("identity", F.coalesce(F.concat(F.lit("id:"), own), F.concat(F.lit("inv:"), joined_hash(*map(F.col, ("timestamp", "model", "kind", "kindLabel", "owningUser", "userEmail"))))))
    e = e.withColumn("occurrence", F.row_number().over(Window.partitionBy("identity").orderBy("timestamp", "page", "place")) - 1)
    number = lambda c: F.col(f"tokenUsage.{c}").try_cast("long")
    return e.select("page", "place", "identity", "occurrence", "timestamp", clean(F.col("model")).alias("model"), provider_of(F.col("model")).alias("provider"), sum_known(number("inputTokens"), number("cacheWriteTokens")).alias("input"), number("outputTokens").alias("output"), number("cacheReadTokens").alias("cached_input"), cents_to_minor(F.coalesce(F.col("chargedCents").try_cast("double"), F.col("tokenUsage.totalCents").try_cast("double"))).alias("amount_minor"))


def billed_drafts(spark: SparkSession, path: str) -> DataFrame:
    """Billed events as drafts, with the cost their source reports."""
    e = billed_events(spark, path)
    return _draft(
        e, source_app=F.lit("cursor"), source_event_id=F.concat_ws("-", F.lit("dashboard"), "identity", F.col("occurrence").cast("string")), raw_timestamp=F.col("timestamp"), provider=F.col("provider"), model=F.col("model"), input=F.col("input"),
        output=F.col("output"), cached_input=F.col("cached_input"), source_ref=F.lit("dashboard-window"), adapter=F.lit(BILLED), origin=F.col("page"), position=F.col("place"), cost_status=F.when(F.col("amount_minor").isNotNull(), "reported_by_source"), amount_minor=F.col("amount_minor"), currency=F.when(F.col("amount_minor").isNotNull(), "USD"),
        exponent=F.when(F.col("amount_minor").isNotNull(), 4),
    )
