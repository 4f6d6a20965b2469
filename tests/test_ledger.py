"""Commits of the ledger against a store kept in a dictionary: order, deletes, totals, one transaction, the feed of changes."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterloom.functions import scalars as X
from meterloom.operators import ledger as totals
from meterloom.operators import views
from meterloom.plans.queries import QUERIES
from meterloom.schema import DRAFT
from meterloom.sources import logs
from meterloom.sources.changes import changes
from meterloom.sources.paths import arrow_uri
from meterloom.sources.tail import tail
from meterloom.streaming import ledger as ledger_module
from meterloom.streaming.ingest import Ledger, Scope, hourly_totals, ingest, ingest_lines, ingest_parsed, normalized
from test_ingest import drafts_of
from test_tail import Steps

T0 = 1785000000 // 3600 * 3600
COLUMNS = "source_app string, source_event_id string, raw_timestamp string, model string, session_id string, input long, output long, adapter string, source_ref string, origin string, position long, cost_status string, amount_minor long, currency string, exponent int"


def utc(seconds):
    return datetime(1970, 1, 1) + timedelta(seconds=seconds)


def draft(event, t=T0, n=1, source="codex", model="m", session="s", adapter="a", ref="r", origin=None, position=None, minor=None, exponent=2):
    priced = (None,) * 4 if minor is None else ("reported_by_source", minor, "usd", exponent)
    return (source, event, None if t is None else str(t), model, session, n, 1, adapter, ref, origin, position, *priced)


def batch(spark, rows):
    return normalized(drafts_of(spark, rows, COLUMNS))


def stored(df):
    return {(r["source_app"], r["source_event_id"]): r["input"] for r in df.collect()}


def test_the_last_of_a_batch_wins(spark, tmp_path):
    """Corrections with the timestamp of what they correct, dealt over partitions, in a thousand keys; and on replay."""
    rng, store = random.Random(1), Ledger(spark, str(tmp_path / "l"))
    for commit in (1, 2):
        rows = [draft(f"e{k}", n=rng.randint(1, 5), origin=f"f{rng.randint(0, 2)}", position=p) for p, k in enumerate(rng.choices(range(1000), k=4000))]
        want = {}
        for r in sorted(rows, key=lambda r: (r[9], r[10])):
            want["codex", r[1]] = r[5]
        before = stored(store.current()) if commit > 1 else {}
        rng.shuffle(rows)
        for _ in range(2):  # the second time a replay
            store.commit(batch(spark, rows).repartition(7), commit)
            assert stored(store.current()) == before | want
    unnumbered = [draft("x", n=k) for k in (3, 9, 4)]
    store.commit(batch(spark, unnumbered).coalesce(1), 3)
    assert stored(store.current())["codex", "x"] == 4


def test_stored_fields_are_clean(spark, tmp_path):
    store = Ledger(spark, str(tmp_path / "l"))
    store.commit(batch(spark, [draft(" a ", model="m ", session="\u00a0 "), draft("b", model="m")]), 1)
    assert sorted((r["source_event_id"], r["model"], r["session_id"]) for r in store.current().collect()) == [("a", "m", None), ("b", "m", "s")]
    assert store.commit(batch(spark, [draft("a", model="m", session=None)]), 2).manifest["changes"]["codex"]["unchanged"] == 1


def random_commits(spark, store, seed, commits=5):
    """Commits of random drafts and scopes, and the store they should leave."""
    rng, want, history = random.Random(seed), {}, []
    for commit in range(1, commits + 1):
        rows = [
            draft(f"e{rng.randint(0, 40)}", rng.choice([None, *(T0 + 1800 * k for k in range(12))]), rng.randint(1, 3), rng.choice(["codex", "cursor"]), rng.choice(["m", "n", None]), rng.choice(["s", "t", None]), rng.choice("ab"), rng.choice("rq"), "f", p, rng.choice([None, 7, 12]), rng.choice([2, 4]))
            for p in range(rng.randint(0, 25))
        ]
        scopes = [Scope("codex", utc(T0 + 1800 * 9), utc(T0 + 1800 * rng.randint(0, 8)), rng.choice(["a", None]), rng.choice(["r", None]))] if commit % 2 == 0 else []
        new = {(r[0], r[1]): r for r in rows}
        gone = {k for s in scopes for k, r in want.items() if k not in new and k[0] == s.source_app and r[2] is not None and s.since <= utc(int(r[2])) < s.until and s.adapter in (None, r[7]) and s.source_ref in (None, r[8])}
        # place, adapter and reference are no content: a record that says the same stays as it is
        content = lambda r: (*r[:7], *r[11:])
        moved = {k: r for k, r in new.items() if k not in want or content(want[k]) != content(r)}
        change = {(k, "deleted") for k in gone} | {(k, "updated" if k in want else "inserted") for k in moved}
        want = {k: r for k, r in want.items() if k not in gone} | moved
        state = store.commit(batch(spark, rows), commit, scopes)
        history.append((dict(want), change, state))
    return history


@pytest.mark.parametrize("seed", [1, 2])
def test_commits_with_scopes(spark, tmp_path, seed):
    """Records, totals by source and model, costs, threads and hours after every commit; states of earlier ones stay readable."""
    store = Ledger(spark, str(tmp_path / "l"))
    history = random_commits(spark, store, seed)
    for commit, (want, _, state) in enumerate(history, 1):
        assert stored(store.at(commit).records()) == {k: r[5] for k, r in want.items()}
    records, state = store.current(), store.at()
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    same = lambda a, b: rows(a.select(sorted(a.columns))) == rows(b.select(sorted(b.columns)))
    assert same(state.totals("source_app", "model"), totals.totals(records, "source_app", "model")) and same(state.totals(), totals.totals(records))
    assert same(state.costs("source_app"), totals.cost_by_currency(records, "source_app"))
    bounds = totals.Filter(sources=("codex",), since=utc(T0 + 3600), until=utc(T0 + 3600 * 4))
    assert same(state.totals("model", wanted=bounds), totals.totals(bounds.apply(records.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))), "model"))
    threads = totals.threads(records.withColumn("event_id", F.lit(0)).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))).drop("first_event", "last_event", "project")
    assert same(state.threads(), threads)
    hours = records.filter("event_ts is not null").groupBy("source_app", F.date_trunc("hour", "event_ts").alias("hour_start")).agg(F.count("*").alias("n"), F.sum("display").alias("tokens"))
    assert same(hourly_totals(store), hours)
    assert not any("/records/" in f for f in state.totals().inputFiles())
    with pytest.raises(ValueError):
        state.totals(wanted=totals.Filter(since=datetime(2024, 1, 1, 0, 30)))


def test_the_feed_gives_what_later_commits_changed(spark, tmp_path):
    store = Ledger(spark, str(tmp_path / "l"))
    history = random_commits(spark, store, 5)
    store.compact(3)
    seen = tmp_path / "seen"

    def read(after):
        got = []
        take = lambda df, n: got.extend(df.collect())
        changes(store, after, ("source_app", "source_event_id", "input")).writeStream.foreachBatch(take).option("checkpointLocation", str(seen / str(after))).trigger(availableNow=True).start().awaitTermination()
        return got

    for after in (0, 2, 4):
        got = read(after)
        assert {(r["commit"], (r["source_app"], r["source_event_id"]), r["outcome"]) for r in got} == {(n, *c) for n, (_, change, _) in enumerate(history, 1) if n > after for c in change}
        held = {k: r[5] for k, r in history[after - 1][0].items()} if after else {}
        for r in sorted(got, key=lambda r: r["commit"]):
            key = r["source_app"], r["source_event_id"]
            held.pop(key, None)
            if r["outcome"] != "deleted":
                held[key] = r["input"]
        assert held == stored(store.current())
    assert read(2) == []
    store.commit(batch(spark, [draft("later")]), 6)
    assert [(r["commit"], r["source_event_id"], r["revision_of_store"]) for r in read(2)] == [(6, "later", store.at().revision)]


def test_a_commit_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    """Killed before each of its writes in turn, and before the manifest: every table stays that of the commit before."""
    quota = lambda used: spark.createDataFrame([("codex", None, 300, used, datetime(2026, 1, 1), datetime(2026, 1, 1, 0, used // 100))], "source_app string, label string, window_minutes int, used_tenths int, resets_at timestamp, observed_at timestamp")
    attempt = spark.createDataFrame([("codex", "succeeded", None, False, None)], "source_app string, outcome string, observed_at timestamp, awaiting boolean, error string")
    point = lambda n: spark.createDataFrame([("a", "u", str(n))], "adapter string, unit string, payload string")
    store = Ledger(spark, str(tmp_path / "l"))
    full = lambda n, rows: store.commit(batch(spark, rows), n, [Scope("codex", datetime(2030, 1, 1))], quota(100 * n), None, attempt, point(n), at=datetime(2026, 1, n))
    full(1, [draft("a", minor=3), draft("b")])

    def tables():
        s = store.at()
        return s.commit, s.revision, [sorted(map(str, df.collect())) for df in (s.records(), s.hours(), s.threads(), s.costs(), s.quotas(), s.samples(), s.health(), s.checkpoints())]

    before, write, swap = tables(), Ledger._write, Ledger._put
    died = 0
    for k in range(40):
        left = [k]

        def dying(self, *args, of=write, left=left):
            left[0] -= 1
            if left[0] < 0:
                raise InterruptedError
            return of(self, *args)

        monkeypatch.setattr(Ledger, "_write", dying)
        monkeypatch.setattr(Ledger, "_put", lambda self, m, over, dying=dying: dying(self, m, over, of=swap))
        try:
            full(2, [draft("a", n=5, minor=4), draft("c")])
        except InterruptedError:
            died += 1
            assert tables() == before
        else:
            break
    assert died > 8 and store.last() == 2
    s = store.at()
    assert stored(s.records()) == {("codex", "a"): 5, ("codex", "c"): 1} and s.checkpoints().first()["payload"] == "2"
    assert [r["used_tenths"] for r in s.quotas().collect()] == [200] and s.samples().count() == 2 and s.revision == 2
    assert stored(store.at(1).records()) == {("codex", "a"): 1, ("codex", "b"): 1}


def test_a_snapshot_of_one_commit(spark, tmp_path):
    """All frames of an earlier commit while later ones go on, totals and count without a record."""
    store = Ledger(spark, str(tmp_path / "l"))
    random_commits(spark, store, 8, 3)
    state = store.at(2)
    store.commit(batch(spark, [draft("late", source="claude_code", n=99)]), 4)
    codex = totals.Filter(sources=("codex",))
    shot = views.snapshot_at(state, totals.Filter(), codex, 5)
    records = state.records().withColumns({"event_ts": F.col("event_ts").cast("timestamp_ntz"), "event_id": F.col("id")})
    plain = views.snapshot(records, state.revision, totals.Filter(), codex, 5)
    rows = lambda df: sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))
    for name in ("overview", "summary", "threads", "recent", "count"):
        assert rows(getattr(shot, name)) == rows(getattr(plain, name)), name
    assert shot.revision == state.revision == 2 and not any("/records/" in f for f in shot.overview.inputFiles() + shot.count.inputFiles())
    assert shot.quotas.count() == shot.health.count() == 0


def test_revision_samples_and_health(spark, tmp_path):
    """Readings that say the same are no sample, the time of an attempt is no change."""
    store, day = Ledger(spark, str(tmp_path / "l")), datetime(2026, 1, 1)
    quota = lambda used, minute, reset=day: spark.createDataFrame([("codex", "p", 300, used, reset, day + timedelta(minutes=minute))], "source_app string, label string, window_minutes int, used_tenths int, resets_at timestamp, observed_at timestamp")
    attempt = lambda outcome, error=None, seen=None: spark.createDataFrame([("codex", outcome, seen, None, error)], "source_app string, outcome string, observed_at timestamp, awaiting boolean, error string")
    steps = [
        (dict(quotas=quota(10, 1)), 1), (dict(quotas=quota(10, 2)), 2), (dict(quotas=quota(10, 3, day + timedelta(seconds=100))), 3), (dict(quotas=quota(10, 4, day + timedelta(hours=5))), 4), (dict(quotas=quota(9, 1)), 4),
        (dict(attempts=attempt("succeeded")), 5), (dict(attempts=attempt("started")), 6), (dict(attempts=attempt("offline", "no net")), 7), (dict(attempts=attempt("offline", "no net")), 7), (dict(attempts=attempt("succeeded", seen=day)), 8),
        (dict(quotas=quota(5, 9).filter("false"), replace_quotas_of="codex"), 9),
    ]
    for n, (what, revision) in enumerate(steps, 1):
        assert (n, store.commit(None, n, at=day + timedelta(days=n), **what).revision) == (n, revision)
    at = lambda n: store.at(n).health().select("state", F.dayofmonth("last_attempt_at"), F.dayofmonth("app_synced_at"), F.dayofmonth("source_observed_at"), "last_error").first()
    assert [tuple(at(n)) for n in (6, 7, 9, 10)] == [("current", 7, 7, 7, None), ("syncing", 8, 7, 7, None), ("offline", 10, 7, 7, "no net"), ("current", 11, 11, 1, None)]
    assert store.at().quotas().count() == 0 and store.at().samples().count() == 2
    assert store.prune_samples(day + timedelta(days=62, minutes=3), 12).samples().count() == 1 and store.at(11).samples().count() == 2


def test_a_batch_of_a_stream_is_committed_once(spark, tmp_path):
    source, store = tmp_path / "in", Ledger(spark, str(tmp_path / "l"))
    source.mkdir()
    line = lambda i, n: json.dumps(dict(source_app="codex", source_event_id=i, raw_timestamp=str(T0), input=n, output=1))
    (source / "1.json").write_text(line("a", 1))
    run = lambda: ingest(spark.readStream.schema(DRAFT).json(str(source)), store, str(tmp_path / "c")).awaitTermination()
    run()
    (tmp_path / "c/commits/0").unlink()  # the stream doesn't know that its batch was committed
    (tmp_path / "c/commits/.0.crc").unlink(missing_ok=True)
    run()
    assert store.last() == 1 and stored(store.current()) == {("codex", "a"): 1}
    store.commit(batch(spark, [draft("b")]))
    (source / "2.json").write_text(line("a", 7))
    run()
    assert store.last() == 3 and stored(store.current()) == {("codex", "a"): 7, ("codex", "b"): 1}


# appended logs -------------------------------------------------------------------------------------------------------
def test_the_tail_goes_on_after_a_restart_with_a_log_gone(tmp_path):
    logs_dir, places = tmp_path / "logs", str(tmp_path / "places.json")
    logs_dir.mkdir()
    gone, kept = logs_dir / "gone.jsonl", logs_dir / "kept.jsonl"

    def again(start, places=None):
        steps = Steps(logs_dir)
        steps.reader.places = places
        if places:
            steps.reader.__init__(str(logs_dir), "*.jsonl", 7, places)
        steps.start = start
        return steps

    for where in (None, places):
        gone.write_bytes(b"one\n")
        kept.write_bytes(b"a\n")
        steps = again({}, where)
        assert sorted(steps()) == [(0, "a"), (0, "one")]
        away = gone.rename(tmp_path / "away")
        kept.write_bytes(b"a\nb\n")
        steps = again(steps.start, where)  # started again without the log
        assert steps() == [(2, "b")] and steps() == [] and steps() == []
        away.rename(gone)
        gone.write_bytes(b"one\ntwo\n")
        kept.chmod(0)
        assert steps() == [(4, "two")]  # it came back and goes on, and the other one isn't opened
        kept.chmod(0o644)
        gone.unlink()
        assert steps() == []


def test_a_log_that_goes_between_plan_and_read(tmp_path):
    log, steps = tmp_path / "a.jsonl", Steps(tmp_path)
    log.write_bytes(b"one\n")
    end = steps.reader.latestOffset()
    parts = steps.reader.partitions({}, end)
    log.unlink()
    assert [list(steps.reader.read(p)) for p in parts] == [[]]


def rollout(n, rng, own="own"):
    lines = [{"type": "session_meta", "payload": {"id": own, "cwd": "/a/meta", "model_provider": "openai"}}]
    for k in range(n):
        kind = rng.random()
        if kind < 0.2:
            lines.append({"type": "turn_context", "payload": {"model": f"m{k}", **({"cwd": f"/a/turn{k}"} if rng.random() < 0.5 else {})}})
        elif kind < 0.3:
            lines.append({"type": "event_msg", "payload": {"type": "token_count", "info": None}})
        else:
            lines.append({"timestamp": "2026-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": k, "output_tokens": 1}}}})
    return [json.dumps(x) + "\n" for x in lines]


def test_rollouts_read_in_pieces_equal_those_read_whole(spark, tmp_path):
    rng, folder = random.Random(3), tmp_path / "logs"
    folder.mkdir()
    files = {folder / f"rollout-x-{k}{'0' * 35}.jsonl": "".join(rollout(30, rng, f"own{k}")).encode() for k in range(3)}
    store = Ledger(spark, str(tmp_path / "l"))
    ends = dict.fromkeys(files, 0)
    while any(ends[f] < len(b) for f, b in files.items()):
        for f, b in files.items():
            ends[f] = min(len(b), ends[f] + rng.randint(0, 1500))
            f.write_bytes(b[: ends[f]])
        ingest_parsed(tail(spark, str(folder), "rollout-*.jsonl", 200), logs.rollouts, store, str(tmp_path / "c")).awaitTermination()
    names = ("source_event_id", "provider", "model", "project", "session_id", "source_ref", "input")
    whole = sorted(map(str, (tuple(r) for r in normalized(logs.rollout_drafts(spark, str(folder))).select(*names).collect())))
    assert sorted(map(str, (tuple(r) for r in store.current().select(*names).collect()))) == whole and len(whole) > 40
    assert store.at().checkpoints().count() == 3 and store.last() > 2
    first = next(iter(files))  # written anew: it counts from nothing again
    first.write_bytes("".join(rollout(2, random.Random(9))).encode())
    ingest_parsed(tail(spark, str(folder), "rollout-*.jsonl"), logs.rollouts, store, str(tmp_path / "c")).awaitTermination()
    assert json.loads(store.at().checkpoints().filter(F.col("unit").startswith("0")).first()["payload"])["counted"] <= 2


def test_a_message_in_two_transcripts(spark, tmp_path):
    line = lambda out: json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "assistant", "sessionId": "s", "message": {"id": "a", "model": "m", "usage": {"output_tokens": out}}}) + "\n"
    for order in (("a", "b"), ("b", "a")):
        folder = tmp_path / order[0]
        folder.mkdir()
        for k, name in enumerate(order):
            (folder / f"{name}.jsonl").write_text(line(k))
        store = Ledger(spark, str(folder / "l"))
        ingest_lines(tail(spark, str(folder)), logs.transcripts, store, str(folder / "c")).awaitTermination()
        assert store.current().first()["output"] == order.index("b")


def test_addresses():
    assert [arrow_uri(u) for u in ("s3a://b/k", "s3n://b", "wasbs://c@a/x", "abfss://c@a/x", "gs://b/k", "hdfs://n:8020/x", "file:/tmp/x", "file:///tmp/x", "/tmp/x")] == ["s3://b/k", "s3://b", "abfss://c@a/x", "abfss://c@a/x", "gs://b/k", "hdfs://n:8020/x", "/tmp/x", "/tmp/x", "/tmp/x"]


def test_writers_that_meet_both_commit(spark, tmp_path, monkeypatch):
    """A writer finds its number taken, twice, by one that changes the same keys; its own commit follows theirs."""
    store, other = Ledger(spark, str(tmp_path / "l")), Ledger(spark, str(tmp_path / "l"))
    store.commit(batch(spark, [draft("a"), draft("gone")]))
    put, rivals = Ledger._put, [[draft("a", n=2), draft("b")], [draft("a", n=3), draft("c")]]

    def late(self, manifest, over):
        if self is store and rivals:
            other.commit(batch(spark, rivals.pop(0)))
        return put(self, manifest, over)

    monkeypatch.setattr(Ledger, "_put", late)
    made = store.commit(batch(spark, [draft("a", n=7), draft("c", n=3)]), scopes=[Scope("codex", datetime(2030, 1, 1))])
    assert made.commit == 4 and store.commits() == [1, 2, 3, 4]
    assert stored(store.current()) == {("codex", "a"): 7, ("codex", "c"): 3}
    assert stored(store.at(3).records()) == {("codex", "a"): 3, ("codex", "b"): 1, ("codex", "c"): 1, ("codex", "gone"): 1}
    assert [(r["inserted"], r["updated"], r["deleted"]) for r in store.changes().orderBy("commit").collect()] == [(2, 0, 0), (1, 1, 0), (1, 1, 0), (0, 2, 2)]
    total = store.at().totals().first()
    assert (total["records"], total["input"]) == (2, 10)
    named = {f for n in store.commits() for f in store.manifest(n)["records"]}
    assert {f"data/records/{f.name}" for f in (tmp_path / "l" / "data" / "records").iterdir()} == named  # lost tries have left nothing
    rivals.append([draft("d")])
    with pytest.raises(ValueError, match="another writer"):
        store.commit(batch(spark, [draft("e")]), 5)
    assert store.last() == 5 and ("codex", "e") not in stored(store.current())


def test_what_no_manifest_names_is_removed(spark, tmp_path):
    store, now = Ledger(spark, str(tmp_path / "l")), datetime(2026, 1, 1)
    history = random_commits(spark, store, 6)  # five
    store.commit(batch(spark, [draft("z")]), 6)
    store.commit(batch(spark, [draft("z")]), 6)  # repeated: the folders of the first one are named nowhere
    (tmp_path / "l" / "data" / "records" / "died").mkdir()
    folders = lambda: {f"data/{t.name}/{f.name}" for t in (tmp_path / "l" / "data").iterdir() for f in t.iterdir()}
    all_of = lambda: [sorted(map(str, df.collect())) for s in (store.at(),) for df in (s.records(), s.hours(), s.threads(), s.costs())]
    before, held = all_of(), store.at(2).records()
    assert store.vacuum(now) == []
    assert store.vacuum(now + timedelta(hours=23)) == []
    gone = store.vacuum(now + timedelta(days=1))
    assert "data/records/died" in gone and not set(gone) & folders() and all_of() == before
    assert stored(held) == {k: r[5] for k, r in history[1][0].items()}

    store.compact(5)
    with pytest.raises(ValueError, match="base"):
        store.forget(5)
    store.forget(3)
    assert store.commits() == [4, 5, 6] and all_of() == before
    store.vacuum(now + timedelta(days=2))
    assert stored(held) == {k: r[5] for k, r in history[1][0].items()}  # a reader has until the next day
    size = len(folders())
    assert store.vacuum(now + timedelta(days=3)) and len(folders()) < size and all_of() == before
    assert store.vacuum(now + timedelta(days=9)) == []
    assert stored(store.at(5).records()) == {k: r[5] for k, r in history[4][0].items()}
    store.commit(batch(spark, [draft("later")]))
    assert ("codex", "later") in stored(store.current())

    def read(after):
        got = []
        changes(store, after, ("source_event_id",)).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / str(after))).trigger(availableNow=True).start().awaitTermination()
        return {r["commit"] for r in got}

    assert read(3) == {n for n, (_, change, _) in enumerate(history, 1) if n > 3 and change} | {6, 7}
    with pytest.raises(Exception, match="forgotten"):
        read(2)


@pytest.mark.parametrize("limits", [{"FEW": 0}, {"FEW": 0, "HOT": -(10**9), "CELL_ROWS": 1}])
def test_large_commits(spark, tmp_path, monkeypatch, limits):
    """Batches too large for their keys to be sent about, keys drafted again and again, buckets written by several tasks."""
    for name, value in limits.items():
        monkeypatch.setattr(ledger_module, name, value)
    store = Ledger(spark, str(tmp_path / "l"))
    history = random_commits(spark, store, 3, 4)
    for commit, (want, change, state) in enumerate(history, 1):
        assert stored(store.at(commit).records()) == {k: r[5] for k, r in want.items()}
        counted = {k: sum(n[k] for n in state.manifest["changes"].values()) for k in ("inserted", "updated", "deleted")}
        assert counted == {k: sum(o == k for _, o in change) for k in counted}


def test_commits_shuffle_each_draft_once(spark):
    """Three commits, two of them against stored rows, and the records after them: bytes shuffled for each of 10,000 records."""

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = shuffled()
    assert len(QUERIES["ledger_after_commits"](spark, "/root/testdata/sf0.01").collect()) > 9000
    assert shuffled() - before < 900 * 10_000


def test_packed_strings_come_back(spark):
    texts = ["", "ab", "AB", "abc", "0" * 64, "zz", "é", " ", "00", None, "\x00ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.packed(F.col("t")).alias("p"))
    rows = df.select("t", X.unpacked(F.col("p")).alias("u"), "p").collect()
    assert all(r["t"] == r["u"] for r in rows) and len({bytes(r["p"]) for r in rows if r["p"] is not None}) == len(texts) - 1
    assert {len(r["p"]) for r in rows if r["t"] == "0" * 64} == {33}
