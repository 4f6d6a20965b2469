"""State by key over restarted streams, against the batch versions."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.operators import series, state
from meterloom.schema import QUOTA
from meterloom.streaming import keyed

DAY = datetime(2026, 1, 1)


@pytest.fixture
def store(spark):
    for name, value in keyed.STORE.items():
        spark.conf.set(name, value)
    yield
    for name in keyed.STORE:
        spark.conf.unset(name)


def run(spark, tmp_path, name, batches, schema, of):
    """The rows that each batch gives; every batch is a stream started anew on the same checkpoint."""
    source, out = tmp_path / f"{name}-in", []
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"{k}"))
        got = []
        stream = of(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source)))
        take = lambda df, n, got=got: got.extend(df.collect())
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
        out.append(got)
    return out


def test_samples(spark, tmp_path, store):
    rng, readings = random.Random(2), []
    for n in range(120):
        source, label = rng.choice([("codex", None), ("cursor", "a"), ("cursor", "b")])
        readings.append((source, label, 300, rng.choice([10, 10, 10, 20]), DAY + timedelta(hours=5 * (n // 30), seconds=rng.randint(-50, 50)), DAY + timedelta(minutes=n)))
    got = [r for b in run(spark, tmp_path, "samples", [readings[:50], readings[50:51], readings[51:]], QUOTA, keyed.sampled) for r in b]
    want, marks = [], {}
    for r in readings:
        m = marks.get(r[:3])
        if m is None or m[3] != r[3] or abs(m[4] - r[4]) > timedelta(minutes=2):
            marks[r[:3]] = r
            want.append(r)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and 10 < len(want) < 110
    # one commit after the other, the batch version takes the same
    marks = spark.createDataFrame([], QUOTA)
    taken = 0
    for r in readings[:8]:
        taken += state.changed_samples(spark.createDataFrame([r], QUOTA), marks.filter("false") if taken == 0 else marks).count()
        held = {}
        for x in readings[: readings.index(r) + 1]:
            m = held.get(x[:3])
            held[x[:3]] = x if m is None or m[3] != x[3] or abs(m[4] - x[4]) > timedelta(minutes=2) else m
        marks = spark.createDataFrame(list(held.values()), QUOTA)
    assert taken == sum(r in readings[:8] for r in want)


def test_alerts_fire_once(spark, tmp_path, store):
    """Neither in a later batch nor after a restart, nor when snoozed; a key whose window is gone is forgotten."""
    later, past = datetime.now() + timedelta(days=1), datetime.now() - timedelta(days=1)
    alert = lambda key, reset=later: (key, "codex", "t", "b", reset, False)
    snooze = lambda key: (key, None, None, None, later, True)
    batches = [[alert("a"), alert("a"), alert("b")], [alert("a"), alert("c"), snooze("d"), alert("old", past)], [alert("d"), alert("b"), alert("e"), alert("old", past)], [alert("old", past)]]
    split = lambda df: keyed.fired_once(df.filter("not snooze").drop("snooze"), df.filter("snooze"))
    got = run(spark, tmp_path, "alerts", batches, keyed.ALERT + ", snooze boolean", split)
    fired = [sorted(r["alert_key"] for r in b) for b in got]
    assert fired[:2] == [["a", "b"], ["c", "old"]] and [k for k in fired[2] if k != "old"] == ["e"]
    assert "old" in fired[2] + fired[3]  # its timer ran out in between


def test_tiles(spark, tmp_path, store):
    rng = random.Random(6)
    rows = sorted(((rng.choice("ab"), DAY + timedelta(minutes=rng.randint(0, 6000))) for _ in range(150)), key=lambda r: r[1])
    got = [r for b in run(spark, tmp_path, "tiles", [rows[:70], rows[70:71], rows[71:]], "session_id string, t timestamp", keyed.tiles) for r in b]
    want = {}
    for key, t in rows:
        tiles = want.setdefault(key, [])
        if not tiles or t >= tiles[-1] + timedelta(minutes=300):
            tiles.append(t)
    assert sorted((r["session_id"], r["opened_at"]) for r in got) == sorted((k, t) for k, each in want.items() for t in each)
    now = rows[-1][1]
    whole = series.tiled_sessions(spark.createDataFrame(pd.DataFrame(rows, columns=["session_id", "t"])).withColumn("t", F.col("t").cast("timestamp_ntz")), "session_id", now)
    assert {r["session_id"]: r["resets_at"] for r in whole.collect()} == {k: each[-1] + timedelta(minutes=300) if each[-1] + timedelta(minutes=300) > now else None for k, each in want.items()}
