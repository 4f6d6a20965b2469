"""Wording, cycle-usage answers, the snapshot and compaction against values worked out by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterloom.functions import scalars as X
from meterloom.functions import wording as T
from meterloom.operators import ledger, state, views
from meterloom.sources import logs
from meterloom.sources.events_bridge import records
from meterloom.streaming.ingest import Ledger, normalized
from test_ingest import drafts_of


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_wording(spark):
    n, s = lambda x: F.lit(x).cast("long"), F.lit
    now = s(datetime(2024, 1, 20, 15)).cast("timestamp_ntz")
    t = lambda *x: s(datetime(*x)).cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    assert values(spark, *(T.runway_text(n(m)) for m in (None, 0, 25, 60, 100, 1440, 3060))) == ["—", "<1m", "25m", "1h", "1h 40m", "1d", "2d 3h"]
    assert values(spark, *(T.ago(x, now) for x in (none, t(2024, 1, 20, 15, 1), t(2024, 1, 20, 14, 59, 20), t(2024, 1, 20, 14, 54), t(2024, 1, 20, 12), t(2024, 1, 18)))) == ["never", "just now", "40s ago", "6m ago", "3h ago", "2d ago"]
    assert values(spark, *(T.window_words(n(m)) for m in (300, 10080, 1440, 43200, 120, 90))) == ["this session", "this week", "today", "this 30d period", "this 2h window", "this 90min window"]
    assert values(spark, *(T.window_tag(n(m)) for m in (300, 10080, 1440, 44640, 90))) == ["5h", "week", "day", "31d", "90min"]
    assert values(spark, *(T.pool_name(s(x), s("cursor"), n(300)) for x in ("Cursor Models", "Other Models", None))) == ["own models", "other models", "5h"]
    assert values(spark, T.reset_text(none, now), T.reset_text(t(2024, 1, 20, 18, 5), now), T.reset_text(t(2024, 1, 22, 9), now)) == ["not started", "resets 18:05", "resets Jan 22 09:00"]
    assert values(spark, T.even_pace_note(n(75), n(300)), T.even_pace_note(n(300), n(300))) == ["even pace would be 75% used by now", None]
    assert values(spark, *(T.pace_compact(s(x), n(90)) for x in ("red", "amber", "green", "exhausted", "notStarted", "unknown"))) == ["out in 1h 30m", "at the edge", "on track", "used up", None, None]
    assert values(spark, T.day_span(t(2024, 1, 2), t(2024, 1, 2, 5)), T.day_span(t(2024, 1, 2), t(2024, 2, 3)), T.day_span(none, t(2024, 2, 3)), T.day_span(none, none)) == ["Jan 2", "Jan 2 – Feb 3", "Feb 3", None]
    assert values(spark, *(T.total_gaps(n(x)) for x in (0, 1, 2000))) == [None, "1 record did not report this", "2,000 records did not report this"]
    assert values(spark, X.format_money(n(123456789), s(2), s("USD")), X.format_money(n(-15), s(3), s("USD")), X.format_money(n(15), s(1), s("USD"), 0), X.format_money(n(12345), s(2), s("USD"), 4)) == ["1,234,567.89 USD", "-0.02 USD", "2 USD", "123.4500 USD"]
    assert values(spark, T.sync_word(s("current"), s(True)), T.sync_word(s("current"), s(False)), T.sync_word(s("unknown"), s(False))) == ["awaiting billing", "watching", "not checked"]
    assert values(spark, T.share_percent(n(1), n(200)), T.share_percent(n(5), n(0))) == [1, 0]


def test_cycle_usage(spark, tmp_path):
    cycle = {"billingCycleStart": "2026-01-01T00:00:00Z", "billingCycleEnd": "2026-01-31T00:00:00Z"}
    answers = [
        {"planUsage": {"autoPercentUsed": "12.34", "apiPercentUsed": 50}, **cycle},
        {"result": {"planUsage": {"totalPercentUsed": 7}, "billingCycleEnd": "1769817600000"}},
        {"data": {"planUsage": {"autoPercentUsed": 1}, "billingCycleStart": cycle["billingCycleEnd"], "billingCycleEnd": cycle["billingCycleStart"]}},
        {"planUsage": {"autoPercentUsed": 1}, "billingCycleEnd": "soon"},
        {"usage": {"planUsage": {}, **cycle}},
    ]
    got = []
    for k, answer in enumerate(answers):
        (tmp_path / f"{k}.json").write_text(json.dumps(answer))
        rows = logs.period_quota(spark, str(tmp_path / f"{k}.json"), datetime(2026, 1, 15)).orderBy("label").collect()
        got.append([(r["label"], r["window_minutes"], r["used_tenths"]) for r in rows])
    assert got == [[("Cursor Models", 43200, 123), ("Other Models", 43200, 500)], [("Total", 43200, 70)], [("Cursor Models", 43200, 10)], [], []]


def test_snapshot_is_of_one_revision(spark, sf_dir):
    s = views.snapshot(records(spark, sf_dir), 7, ledger.Filter(), ledger.Filter(sources=("codex",)), 3)
    assert s.revision == 7 and s.recent.count() == 3 and s.overview.filter("level = 'source'").count() == 3
    assert [r["source_app"] for r in s.summary.filter("level = 'source'").collect()] == ["codex"] and s.count.first()["records"] == 1000
    assert {r["source_app"] for r in s.threads.collect()} == {"codex"}


def test_views_of_nothing(spark, sf_dir):
    none = records(spark, sf_dir).filter("false")
    assert views.model_rows(none).count() == 0 and views.thread_list(none).count() == 0
    assert tuple(views.stat_bar(none).first()) == ("0", "0 in · 0 out", None, "—", None, "0", None)


def test_compaction_keeps_what_is_current(spark, tmp_path):
    store = Ledger(spark, str(tmp_path / "ledger"))
    batch = lambda *rows: normalized(drafts_of(spark, list(rows), "source_app string, source_event_id string, output long"))
    for k, rows in enumerate([[("codex", "a", 1), ("codex", "b", 1)], [("codex", "a", 2)], [("codex", "c", 3)]]):
        store.commit(batch(*rows), k + 1)
    state = lambda: sorted((r["source_event_id"], r["output"], r["revision"]) for r in store.current().collect())
    before = state()
    store.compact(2)
    assert state() == before == [("a", 2, 2), ("b", 1, 1), ("c", 3, 3)]
    store.commit(batch(("codex", "c", 4)), 3)  # the last revision, replayed
    store.commit(batch(("codex", "a", 2), ("codex", "b", 5)), 4)
    assert state() == [("a", 2, 2), ("b", 5, 4), ("c", 4, 3)]
    for wrong in (lambda: store.compact(4), lambda: store.current(before=2)):
        with pytest.raises(ValueError):
            wrong()


def test_limits(spark):
    rows = [(1, "codex", "remaining_percent", 101, True), (2, "cursor", "minutes_until_reset", 10080, False), (3, "codex", "remaining_percent", 100, True), (4, "elsewhere", "remaining_percent", 1, True), (5, "claude_code", "mood", 1, True)]
    options = spark.createDataFrame(rows, "seq long, source_app string, metric string, limit_value long, enabled boolean")
    of = lambda df: {r["source_app"]: (r["metric"], r["limit_value"], r["enabled"], r["problem"]) for r in state.limits(df).collect()}
    assert of(options) == {"codex": ("remaining_percent", 100, True, None), "cursor": ("minutes_until_reset", 10080, False, None), "claude_code": ("mood", 1, True, "unknown metric")}
    assert of(options.filter("seq = 1"))["codex"][3] == "limit out of range" and of(options.filter("false"))["cursor"] == ("remaining_percent", 25, True, None)


def test_outcomes(spark):
    kinds = spark.createDataFrame([(None,), ("offline",), ("rate_limited",), ("parse",)], "kind string")
    assert [r["o"] for r in kinds.select(state.outcome_of(F.col("kind")).alias("o")).collect()] == ["succeeded", "offline", "offline", "failed"]
