"""Sources end to end: sessions worked out from activity, the freshest files alone, billed feeds over placeholders, failures."""

import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterloom.functions import scalars as X
from meterloom.sources import adapters, logs
from meterloom.streaming.ingest import Ledger
from test_ingest import drafts_of, write
from test_ledger import COLUMNS, draft, stored

NOW = datetime(2026, 3, 2, 12)


def stamp(t):
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def session(spark, tmp_path, name, ended, times, week=None, limit=None):
    """Allowances at NOW, given the cached session's reset, the times of messages and the week's reset."""
    folder = tmp_path / name
    one = lambda reset: {"utilization": 40, "resets_at": reset and stamp(reset)}
    cache = {"cachedUsageUtilization": {"fetchedAtMs": 1772400000000, "utilization": {"five_hour": one(ended), **({"seven_day": one(week)} if week else {})}}}
    folder.mkdir()
    (folder / "cache.json").write_text(json.dumps(cache if ended else {}))
    lines = [{"timestamp": stamp(t), "type": "user"} for t in times]
    if limit:
        lines.append({"timestamp": stamp(limit), "error": "rate_limit", "message": {"content": [{"type": "text", "text": "You've hit your session limit · resets 2pm (Europe/London)"}]}})
    (folder / "logs").mkdir()
    (folder / "logs/a.jsonl").write_text("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in lines))
    rows = logs.allowances_at(spark, str(folder / "cache.json"), str(folder / "logs"), NOW).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("resets_at", "observed_at")}).collect()
    return [(r["window_minutes"], r["used_tenths"], r["resets_at"], r["observed_at"]) for r in rows]


def test_session_allowances(spark, tmp_path):
    hours = lambda n: NOW - timedelta(hours=n)
    fetched = datetime(2026, 3, 1, 21, 20)
    assert session(spark, tmp_path, "live", hours(-1), [hours(1)]) == [(300, 400, hours(-1), fetched)]
    assert session(spark, tmp_path, "none", hours(9), []) == [(300, 0, None, fetched)]
    assert session(spark, tmp_path, "before", hours(9), [hours(10)]) == [(300, 0, None, fetched)]
    assert session(spark, tmp_path, "over", hours(20), [hours(15), hours(12)]) == [(300, 0, None, NOW)]
    assert session(spark, tmp_path, "runs", hours(20), [hours(15), hours(12), hours(10), hours(7), hours(3), hours(1)]) == [(300, 0, hours(-2), hours(3))]
    assert session(spark, tmp_path, "week", hours(20), [hours(2)], week=hours(-30)) == [(300, 0, hours(-3), hours(2)), (10080, 400, hours(-30), fetched)]
    assert session(spark, tmp_path, "limit", None, [], limit=hours(1)) == [(300, 1000, hours(-2), hours(1))]
    assert session(spark, tmp_path, "nothing", None, [hours(1)]) == []


def test_line_timestamps(spark):
    lines = ['{"timestamp":"2026-01-01T00:00:00Z","x":1}', '{"a":{"timestamp":"2026-01-01T02:00:00+02:00"},"timestamp":"x"}', '{"timestamp":"2026-01-01"}', '{"timestamp": "2026-01-01T00:00:00Z"}', "", '{"timestamp":"2026-01-01T00:00:00']
    df = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k int, v string").select("k", X.line_timestamp(F.col("v")).cast("timestamp_ntz").alias("t"))
    assert [r["t"] for r in df.orderBy("k").collect()] == [datetime(2026, 1, 1)] * 2 + [None] * 4


def test_only_the_freshest_files_are_opened(spark, tmp_path, monkeypatch):
    for k in range(14):
        log = tmp_path / f"{k:02d}.jsonl"
        write(log, [{"timestamp": stamp(NOW), "error": "rate_limit", "message": {"content": [{"type": "text", "text": f"You've hit your session limit · resets {k % 12 + 1}pm (UTC)"}]}}] if k == 5 else [])
        os.utime(log, (1772400000 + k, 1772400000 + k))
    assert [os.path.basename(p) for p in logs.freshest(spark, str(tmp_path), "*.jsonl", 3)] == ["13.jsonl", "12.jsonl", "11.jsonl"]
    assert len(logs.freshest(spark, str(tmp_path), "*.jsonl", since=datetime.fromtimestamp(1772400008, UTC).replace(tzinfo=None))) == 6
    opened, of = [], logs.lines
    monkeypatch.setattr(logs, "lines", lambda spark, path, glob: opened.extend(map(os.path.basename, path)) or of(spark, path, glob))
    got = logs.limit_quota(spark, str(tmp_path), str(NOW)).collect()
    assert [r["used_tenths"] for r in got] == [1000] and sorted(opened) == [f"{k:02d}.jsonl" for k in range(4, 14)]
    opened.clear()
    assert logs.activity(spark, str(tmp_path), datetime.fromtimestamp(1772400012, UTC).replace(tzinfo=None)).count() == 0 and sorted(opened) == ["12.jsonl", "13.jsonl"]


def bubble(conversation, k, kind, at, tokens=(0, 0), **more):
    return {"conversationId": conversation, "bubbleId": f"{conversation}{k}", "type": kind, "createdAt": at, "inputTokens": tokens[0], "outputTokens": tokens[1], **more}


def test_bubbles_become_records(spark, tmp_path):
    t = lambda k: stamp(NOW + timedelta(minutes=k))
    rows = [bubble("c", 0, 1, t(0), model="u1", requestId="q0"), bubble("c", 1, 2, t(1), (5, 7), usageUuid="use"), bubble("c", 2, 2, t(2), (1, 0), usageUuid=" "), bubble("c", 3, 1, t(3), model="u2", requestId="q3"), bubble("c", 4, 2, t(4)), bubble("d", 0, 1, str(int(NOW.replace(tzinfo=UTC).timestamp() * 1000)))]
    write(tmp_path / "b/x.jsonl", rows)
    store = Ledger(spark, str(tmp_path / "l"))
    adapters.refresh(store, adapters.Bubbles(str(tmp_path / "b")), NOW)
    got = {r["source_event_id"]: (r["model"], r["input"], r["output"], r["display"], r["session_id"]) for r in store.current().collect()}
    assert got == {"use": ("u1", 5, 7, 12, "c"), "c2": ("u1", 1, 0, 1, "c"), "q3": ("u2", None, None, None, "c"), "d0": (None, None, None, None, "d")}
    assert {r["source_event_id"]: r["event_ts"] for r in store.current().withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz")).collect()}["d0"] == NOW


def pages(path, events):
    path.write_text(json.dumps({"usageEventsDisplay": [{"timestamp": str(int(t.replace(tzinfo=UTC).timestamp() * 1000)), "model": "gpt-x", "requestId": i, "tokenUsage": {"inputTokens": n}} for i, t, n in events]}))
    return str(path)


def test_billed_events_replace_what_they_no_longer_hold(spark, tmp_path):
    """Deletes inside the window read again, none before it; placeholders go with the feed that has passed them."""
    day = lambda k: NOW - timedelta(days=k)
    store = Ledger(spark, str(tmp_path / "l"))
    write(tmp_path / "b/x.jsonl", [bubble("c", k, 1, stamp(t), requestId=f"live{k}") for k, t in enumerate((day(2), day(0.5)))])
    adapters.refresh(store, adapters.Bubbles(str(tmp_path / "b"), live=True), NOW)
    first = adapters.refresh(store, adapters.Billed(pages(tmp_path / "1.json", [("old", day(20), 1), ("gone", day(1.1), 2), ("kept", day(1), 3)])), NOW)
    keys = lambda: {e.replace("dashboard-id:", "") for _, e in stored(store.current())}
    assert keys() == {"live1", "old-0", "gone-0", "kept-0"} and first.health().first()["awaiting_upstream"]
    later = adapters.refresh(store, adapters.Billed(pages(tmp_path / "2.json", [("kept", day(1), 4), ("new", day(0.1), 5)])), NOW)
    assert keys() == {"old-0", "kept-0", "new-0"} and not later.health().first()["awaiting_upstream"]
    assert {n["deleted"] for n in later.manifest["changes"].values()} == {2}
    adapters.refresh(store, adapters.Billed(pages(tmp_path / "3.json", [("new", day(0.1), 5)]), reconcile=True), NOW)
    assert keys() == {"new-0"}


def test_failures_leave_the_data(spark, tmp_path):
    store = Ledger(spark, str(tmp_path / "l"))
    drafts = drafts_of(spark, [draft("a", source="cursor")], COLUMNS)
    adapters.refresh(store, adapters.Fixture(adapters.Delta(drafts)), NOW)
    before = stored(store.current())
    for kind, said in (("offline", "offline"), ("rate_limited", "offline"), ("parse", "error"), ("discovery", "error")):
        s = adapters.refresh(store, adapters.Fixture(adapters.SourceError(kind, "why")), NOW)
        health = s.health().first()
        assert (health["state"], health["last_error"]) == (said, f"{kind.replace('_', ' ')}: why") and stored(store.current()) == before
    late = drafts.withColumn("input", F.raise_error(F.lit("broken page")).cast("long"))  # fails only when it is read
    s = adapters.refresh(store, adapters.Fixture(adapters.Delta(late)), NOW)
    assert s.health().first()["state"] == "error" and stored(store.current()) == before
    s = adapters.refresh(store, adapters.Rollouts(str(tmp_path / "nowhere")), NOW)
    assert {r["source_app"]: r["state"] for r in s.health().collect()} == {"cursor": "error", "codex": "error"} and stored(store.current()) == before
    s = adapters.refresh(store, adapters.Fixture(adapters.Delta(drafts)), NOW)
    assert {r["source_app"]: r["state"] for r in s.health().collect()}["cursor"] == "current"
    assert set(adapters.REGISTRY) == {"rollouts", "transcripts", "billed", "bubbles", "fixture"}
    with pytest.raises(ValueError):
        adapters.SourceError("mood", "why")
