"""Raw logs to drafts, streaming commits, and series operators against plain Python."""

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterloom.functions import scalars as X
from meterloom.operators import conversations, series, state
from meterloom.schema import DRAFT
from meterloom.sources import logs
from meterloom.streaming.ingest import Ledger, hourly_totals, ingest, normalized


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + "{broken\n")


def test_rollouts(spark, tmp_path):
    count = lambda n, total=None: {"timestamp": f"2026-01-01T00:00:0{n}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "output_tokens": 1, "total_tokens": total}}, "rate_limits": {"primary": {"used_percent": 10.0 + n, "window_minutes": 300, "resets_at": 1785000000}}}}
    write(tmp_path / "a/rollout-x-123456789012345678901234567890123456.jsonl", [{"type": "session_meta", "payload": {"id": "r1", "cwd": "/a/meta", "model_provider": "openai"}}, count(1), {"type": "turn_context", "payload": {"model": "m", "cwd": "/a/turn"}}, {"type": "event_msg", "payload": {"type": "token_count", "info": None}}, count(2, 9)])
    got = logs.rollout_drafts(spark, str(tmp_path)).orderBy("source_event_id").collect()
    assert [(r["source_event_id"], r["model"], r["project"], r["input"], r["reported_total"]) for r in got] == [("r1:0", None, "meta", 1, None), ("r1:1", "m", "turn", 2, 9)]
    assert logs.rollout_quota(spark, str(tmp_path)).first()["used_tenths"] == 120


def test_transcripts(spark, tmp_path):
    line = lambda i, out: {"timestamp": "t", "type": "assistant", "sessionId": "s", "cwd": "/p/q", "message": {"id": i, "model": "m", "usage": {"input_tokens": 2, "cache_creation_input_tokens": 10, "output_tokens": out}}}
    write(tmp_path / "x.jsonl", [line("a", 1), line("a", 5), {"type": "user"}, line("b", 7)])
    got = logs.transcript_drafts(spark, str(tmp_path)).orderBy("source_event_id").collect()
    assert [(r["source_event_id"], r["input"], r["output"], r["cached_input"], r["project"]) for r in got] == [("a", 12, 5, None, "q"), ("b", 12, 7, None, "q")]


def test_bubbles_and_billed_events(spark, tmp_path):
    write(tmp_path / "b/x.jsonl", [{"conversationId": "c", "bubbleId": str(k), "type": t, "createdAt": f"0{k}", "model": m, "inputTokens": n, "outputTokens": 0} for k, (t, m, n) in enumerate([(1, "u1", 0), (2, None, 5), (2, "v", 0), (1, "u2", 0), (2, None, 0)])])
    got = conversations.turn_drafts(logs.bubbles(spark, str(tmp_path / "b"))).orderBy("at").collect()
    assert [(r["kind"], r["model"], r["tokens"]) for r in got] == [("tokens", "u1", 5), ("event", "u2", None)]
    (tmp_path / "p.json").write_text(json.dumps({"usageEventsDisplay": [{"timestamp": "1", "model": "claude-x", "id": " ", "requestId": "q", "tokenUsage": {"inputTokens": 3, "cacheWriteTokens": "2004"}, "chargedCents": 81.25}] * 2}))
    rows = logs.billed_events(spark, str(tmp_path / "p.json")).orderBy("occurrence").collect()
    assert [(r["identity"], r["occurrence"], r["input"], r["amount_minor"], r["provider"]) for r in rows] == [("id:q", 0, 2007, 8125, "anthropic"), ("id:q", 1, 2007, 8125, "anthropic")]


def test_stream_of_drafts(spark, tmp_path):
    row = lambda i, n: dict(source_app="codex", source_event_id=i, raw_timestamp="1785000000", input=n, output=1)
    source, ledger = tmp_path / "in", Ledger(spark, str(tmp_path / "ledger"))
    stream = lambda: ingest(spark.readStream.schema(DRAFT).json(str(source)), ledger, str(tmp_path / "checkpoint")).awaitTermination()
    (source).mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in (row("a", 1), row("b", 2), row("c", -1))))
    stream()
    (source / "2.json").write_text("\n".join(json.dumps(r) for r in (row("a", 9), row("b", 2))))
    stream()
    got = {r["source_event_id"]: (r["input"], r["display"], r["revision"]) for r in ledger.current().collect()}
    assert got == {"a": (9, 10, 2), "b": (2, 3, 1)}
    assert ledger._log(None).count() == 3


def test_hourly_totals_count_late_rows_and_corrections_once(spark, tmp_path):
    row = lambda i, t, n: dict(source_app="codex", source_event_id=i, raw_timestamp=str(t), input=n, output=1)
    source, ledger, hour, new = tmp_path / "in", Ledger(spark, str(tmp_path / "ledger")), 3600, 1785002400 // 3600 * 3600
    old, source_path = new - 29 * 24 * hour, str(source)
    source.mkdir()
    batches = [[row("a", new, 1), row("b", new, 2)], [row("late", old, 5), row("a", new, 9)], [row("b", old, 2)], [row("a", old, 9)]]
    want = [{new: (2, 5)}, {new: (2, 13), old: (1, 6)}, {new: (1, 10), old: (2, 9)}, {old: (3, 19)}]
    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        ingest(spark.readStream.schema(DRAFT).json(source_path), ledger, str(tmp_path / "checkpoint"), hours=True).awaitTermination()
        got = hourly_totals(ledger).select(F.unix_seconds(F.col("hour_start").cast("timestamp")).alias("t"), "n", "tokens").collect()
        assert {r["t"]: (r["n"], r["tokens"]) for r in got} == want[k]


def drafts_of(spark, rows, columns):
    given = spark.createDataFrame(rows, columns)
    return given.selectExpr(*(f"{c}" if c in given.columns else f"cast(null as {t}) as {c}" for c, t in (x.strip().split(" ") for x in DRAFT.split(","))))


def test_hashes_against_plain_python(spark):
    sha = lambda *parts: hashlib.sha256("\x1f".join(parts).encode()).hexdigest()
    rows = [("codex", None, " 1785000000 ", "p", "m ", 5, "estimated", None, None, "reported_by_source", 12, "usd", 2), ("codex", " x ", None, None, None, None, None, 7, "thread", None, None, None, None)]
    columns = "source_app string, source_event_id string, raw_timestamp string, provider string, model string, input long, input_quality string, output long, session_id string, cost_status string, amount_minor long, currency string, exponent int"
    a, b = normalized(drafts_of(spark, rows, columns)).orderBy("source_event_id").collect()
    assert a["dedupe_key"] == sha("v1", "codex", "content", "1785000000", "p", "m", "5", "", "", "", "", "", "") and b["dedupe_key"] == sha("v1", "codex", "event", "x")
    assert a["content_hash"] == sha("v1", "1785000000", "p", "m", "5", "Estimated", "", "Unknown", "", "Unknown", "", "Unknown", "", "", "", "ReportedBySource", "", "12/USD/2")
    assert b["content_hash"] == sha("v1", "", "", "", "", "Unknown", "7", "Exact", "", "Unknown", "", "Unknown", "", "", "thread", "")


def test_a_cost_correction_is_an_update_and_replays_change_nothing(spark, tmp_path):
    columns = "source_app string, source_event_id string, raw_timestamp string, input long, cost_status string, amount_minor long, currency string, exponent int"
    batch = lambda minor: normalized(drafts_of(spark, [("cursor", "e", "1785000000", 1, "reported_by_source", minor, "usd", 2)], columns))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    for revision, minor in ((1, 5), (2, 6), (2, 6), (3, 6)):
        ledger.commit(batch(minor), revision)
    assert [(r["amount_minor"], r["revision"]) for r in ledger.current().collect()] == [(6, 2)]
    assert ledger._log(None).count() == 2


def test_allowance_files(spark, tmp_path):
    cache = {"cachedUsageUtilization": {"fetchedAtMs": 1785000000000, "utilization": {"five_hour": {"utilization": 12.34, "resets_at": None}, "seven_day": {"utilization": 50, "resets_at": "2026-08-01T00:00:00Z"}, "seven_day_opus": {"utilization": 3, "resets_at": "soon"}, "seven_day_sonnet": None}}}
    (tmp_path / "cache.json").write_text(json.dumps(cache))
    got = logs.cached_quota(spark, str(tmp_path / "cache.json")).orderBy("window_minutes").collect()
    assert [(r["window_minutes"], r["label"], r["used_tenths"], r["resets_at"] is None) for r in got] == [(300, None, 123, True), (10080, None, 500, False)]
    line = lambda t, text: {"timestamp": t, "error": "rate_limit", "message": {"content": [{"type": "text", "text": text}]}}
    write(tmp_path / "t/x.jsonl", [line("2026-03-01T10:00:00Z", "You've hit your weekly limit · resets 9am (Europe/Berlin)"), line("2026-03-02T22:30:00Z", "You've hit your session limit · resets 3:40pm (America/Panama)"), {"type": "user"}])
    limit = lambda now: [(r["window_minutes"], r["used_tenths"], r["resets_at"].isoformat()) for r in logs.limit_quota(spark, str(tmp_path / "t"), now).withColumn("resets_at", F.col("resets_at").cast("timestamp_ntz")).collect()]
    assert limit("2026-03-02 23:00:00") == [(300, 1000, "2026-03-03T20:40:00")] and limit("2026-03-04 00:00:00") == []


def test_billed_drafts_go_through_a_ledger(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"usageEventsDisplay": [{"timestamp": "1785000000000", "model": "gpt-x", "requestId": "q", "tokenUsage": {"inputTokens": 3, "outputTokens": 4}, "chargedCents": 2.5}]}))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.commit(normalized(logs.billed_drafts(spark, str(tmp_path / "p.json"))), 1)
    r = ledger.current().first()
    assert (r["source_event_id"], r["display"], r["amount_minor"], r["currency"], r["exponent"]) == ("dashboard-id:q-0", 7, 250, "USD", 4)


def test_spans_over_midnight(spark):
    reset = datetime(2024, 1, 2)
    rows = [("codex", 1440, u, reset + timedelta(seconds=s), datetime(2024, 1, 1, 10, k), k) for k, (u, s) in enumerate([(0, -10), (25, 10)])]
    df = spark.createDataFrame(rows, "source_app string, window_minutes long, used long, resets_at timestamp_ntz, observed_at timestamp_ntz, event_id long")
    assert [r["moved"] for r in series.spans(df).collect()] == [25]


def test_small_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    n = lambda x: F.lit(x).cast("long")
    t = lambda s: F.lit(s).cast("timestamp")
    assert [one(X.format_money(n(m), F.lit(e), F.lit("USD"))) for m, e in ((12345, 2), (12345, 4), (-5, 2), (5, 3))] == ["123.45 USD", "1.23 USD", "-0.05 USD", "0.01 USD"]
    assert [one(X.countable(n(3), F.lit(q))) for q in ("exact", "estimated", "partial", "unknown")] == [3, 3, 3, None]
    assert [one(f(t("2024-01-01 00:00:00"), t("2024-01-01 00:01:31"))) for f in (X.minutes_floor, X.minutes_ceil, X.minutes_round)] == [1, 2, 2]
    assert [one(X.compact_duration(n(m))) for m in (59, 89, 90, 2879, 2880, 3600)] == ["59m", "1h", "2h", "48h", "2d", "3d"]
    assert one(X.group_digits(n(1234567))) == "1,234,567" and one(X.thread_name(F.lit(" "), F.lit("abcdefgh"))) == "thread abcdef"
    assert state.delta_window(datetime(2024, 1, 31), datetime(2024, 1, 31, 1)) == (datetime(2024, 1, 30, 18), datetime(2024, 1, 31, 1))


def test_identity_vector(spark):
    r = normalized(drafts_of(spark, [("codex", "e1")], "source_app string, source_event_id string")).first()
    assert r["dedupe_key"] == "f1784be1080648345fb30e16cc2084d5e01e8ff4cdcd94ba7fa9486e805badc6" and r["id"] == "codex_f1784be108064834"


def test_timestamps(spark):
    offset, utc, bad = "explicit_offset", "assumed_utc", "unparsable"
    cases = {"1785000000": offset, "1785000000000": offset, "-1785000000": offset, "2026-07-29T10:30:00-05:00": offset, "2026-07-29 10:30:00": utc, "2026-07-29 10:30": utc, "2026-07-29T10:30": utc, "2026-07-29": utc, "next week": bad, " ": "missing", "10:30": bad, "9" * 19: bad, "9" * 30: bad}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", X.timestamp_kind(F.col("s")).alias("k"), F.unix_seconds(X.parse_timestamp(F.col("s"))).alias("t")).collect()
    assert {r["s"]: r["k"] for r in rows} == cases
    at = {r["s"]: r["t"] for r in rows}
    assert (at["1785000000"], at["1785000000000"], at["-1785000000"]) == (1785000000, 1785000000, -1785000000)
    assert at["2026-07-29 10:30"] == at["2026-07-29T10:30"] == at["2026-07-29 10:30:00"] == at["2026-07-29T10:30:00-05:00"] - 5 * 3600


def test_spans_against_a_loop(spark):
    t0 = datetime(2024, 1, 1)
    samples = [("codex", 1440, u, t0 + timedelta(days=1), t0 + timedelta(minutes=7 * k), k) for k, u in enumerate([0, 5, 19, 25, 24, 30, 46, 3, 70, 71, 91])]
    df = spark.createDataFrame(samples, "source_app string, window_minutes long, used long, resets_at timestamp_ntz, observed_at timestamp_ntz, event_id long")
    want, anchor = [], samples[0]
    for s in samples[1:]:
        if max(0, s[2] - anchor[2]) >= 20:
            want.append((anchor[4], s[4], s[2] - anchor[2]))
            anchor = s
    assert [tuple(r) for r in series.spans(df).orderBy("t0").select("t0", "t1", "moved").collect()] == want


def test_session_tiling(spark):
    day = datetime(2026, 1, 1)
    tiled = lambda hours, now: series.tiled_sessions(spark.createDataFrame([("s", day + timedelta(hours=h)) for h in hours], "k string, t timestamp_ntz"), "k", now).first()["resets_at"]
    assert tiled([1 / 6, 2, 5.5], day + timedelta(hours=6)) == day + timedelta(hours=10.5)
    assert tiled([1 / 6, 2], day + timedelta(hours=6)) is None


def test_session_tiling_against_a_loop(spark):
    import random

    rng, day, now, length = random.Random(4), datetime(2026, 1, 1), datetime(2026, 1, 9), timedelta(minutes=300)
    rows = [(k, day + timedelta(minutes=rng.randint(0, 15_000))) for k in ["a", "b", None, "c"] for _ in range(700)] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    want = {}
    for k in {k for k, _ in rows}:
        anchor = None
        for t in sorted(t for x, t in rows if x == k and t is not None):
            if anchor is None or (t >= anchor + length and anchor + length <= now):
                anchor = t
        want[k] = anchor + length if anchor and anchor + length > now else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # sessions go on over batches
    try:
        tiled = series.tiled_sessions(df, "k", now)
        got = [tuple(r) for r in tiled.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and dict(got) == want
    assert "collect_set" not in tiled._jdf.queryExecution().optimizedPlan().toString()


def test_session_tiling_from_resets_one_row_each(spark):
    """Joins of large tables deal both sides by session already; a session still is in one task."""
    now, day = datetime(2026, 1, 1, 17), datetime(2026, 1, 1)
    times = spark.range(0, 40_000, 1, 2).select(F.concat(F.lit("s"), (F.col("id") % 400).cast("string")).alias("k"), (F.lit(day) + F.make_dt_interval(mins=F.col("id") / 40)).cast("timestamp_ntz").alias("t"))
    resets = times.groupBy("k").agg((F.min("t") + F.expr("INTERVAL 12 HOURS")).alias("reset"))
    want = [tuple(r) for r in series.tiled_sessions(times, "k", now, resets=resets).collect()]
    # sides of the union that are coalesced differently
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        got = [tuple(r) for r in series.tiled_sessions(times, "k", now, resets=resets).collect()]
    finally:
        for k in large:
            spark.conf.unset(k)
    assert len(got) == 400 and sorted(got) == sorted(want) and any(r[1] is not None for r in got)
