"""State by key over streams: readings that change an allowance, alerts that fire once, windows that tile forward.

Each is a `transformWithStateInPandas` over its key with one small value, so that no history is read again, and gives what
the batch versions give (`operators.state`, `operators.series`). State goes when it can no longer matter: a window's or
an alert's by a timer at its reset, a sample's mark after the days that samples are kept. Streams need the RocksDB state
store, see `STORE`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import pooled
from ..operators.state import SAMPLE_DAYS
from ..schema import INSTANCE_TOLERANCE_US, QUOTA, SESSION_MINUTES

#: The state store that these operators need. Timers and ages are looked at when there is data: without the second setting a
#: stream that should end once all is read would go on making empty batches for their sake.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

ALERT = "alert_key string, source_app string, title string, body string, resets_at timestamp"
_DAY_MS = 86_400_000


def _micros(t) -> int | None:
    return None if pd.isna(t) else pd.Timestamp(t).value // 1000


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        # texts as plain objects: the way back to the JVM doesn't take the chunks of those that Arrow backs
        pd.set_option("future.infer_string", False)

    def close(self) -> None:
        pass


class _Samples(_Processor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.mark = handle.getValueState("mark", "used int, resets long, observed long", ttlDurationMs=SAMPLE_DAYS * _DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get() if self.mark.exists() else None
        batch = pd.concat(rows).sort_values("observed_at", kind="stable")
        kept = []
        for k, (used, resets, observed) in enumerate(zip(batch["used_tenths"], batch["resets_at"], batch["observed_at"], strict=True)):
            new = (int(used), _micros(resets), _micros(observed))
            if mark is not None and new[2] <= mark[2]:
                continue  # an older reading says nothing of now
            same = mark is not None and new[0] == mark[0] and (new[1] == mark[1] or (None not in (new[1], mark[1]) and abs(new[1] - mark[1]) <= INSTANCE_TOLERANCE_US))
            # what the next reading is held against is the last sample; only the clock moves on
            mark = (mark[0], mark[1], new[2]) if same else new
            if not same:
                kept.append(k)
        if mark is not None:
            self.mark.update(tuple(mark))
        if kept:
            yield batch.iloc[kept]


def sampled(readings: DataFrame) -> DataFrame:
    """A stream of readings (columns of QUOTA) as the samples that change something, in order of time within each window.

    Readings of one window come in order of time or not at all: one that is not newer than the last is left out, as where
    allowances are merged.
    """
    keyed = pooled(readings).select(*(c.strip().split(" ")[0] for c in QUOTA.split(",")), "pool")
    out = keyed.groupBy("source_app", "pool", "window_minutes").transformWithStateInPandas(_Samples(), QUOTA + ", pool string", "Append", "ProcessingTime")
    return out.drop("pool")


class _Fired(_Processor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.held = handle.getValueState("held", "fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows)
        alerts = batch[~batch["snooze"]]
        fires = not self.held.exists() and not batch["snooze"].any() and len(alerts) > 0
        if not self.held.exists():
            self.held.update((True,))
            resets = batch["resets_at"].dropna()
            if len(resets):
                self.handle.registerTimer(int(resets.max().value // 1_000_000))
        if fires:
            yield alerts.iloc[:1].drop(columns="snooze")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()  # the window is gone, and its key can't come back
        return iter(())


def fired_once(alerts: DataFrame, snoozes: DataFrame | None = None) -> DataFrame:
    """A stream of active alerts (columns of ALERT) as those that are shown: each key once, none that is snoozed.

    `snoozes` (alert_key, resets_at) is a stream too; a snooze holds until its window's reset, as what has been shown does. A
    projected alert that comes and goes within a window isn't shown again.
    """
    columns = [c.strip().split(" ")[0] for c in ALERT.split(",")]
    rows = alerts.select(*columns, F.lit(False).alias("snooze"))
    if snoozes is not None:
        none = {c: F.lit(None).cast("string").alias(c) for c in ("source_app", "title", "body")}
        rows = rows.unionByName(snoozes.select("alert_key", *none.values(), "resets_at", F.lit(True).alias("snooze")))
    return rows.groupBy("alert_key").transformWithStateInPandas(_Fired(), ALERT, "Append", "ProcessingTime")


class _Tiles(_Processor):
    def __init__(self, minutes: int):
        self.length = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.opened = handle.getValueState("opened", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(x for x in (_micros(t) for t in pd.concat(rows)["t"]) if x is not None)
        at, opened = (self.opened.get()[0] if self.opened.exists() else None), []
        for t in times:
            if at is None or t >= at + self.length:
                at = t
                opened.append(t)
        if opened:
            self.opened.update((at,))
            stamp = lambda values: pd.to_datetime(pd.Series(values, dtype="int64"), unit="us")
            yield pd.DataFrame({"session_id": [key[0]] * len(opened), "opened_at": stamp(opened), "resets_at": stamp([t + self.length for t in opened])})


def tiles(times: DataFrame, minutes: int = SESSION_MINUTES) -> DataFrame:
    """A stream of times (session_id, t) as the windows they open: (session_id, opened_at, resets_at), the first time at or
    after a window's end opening the next. Times that come late, before the window that is open, open none."""
    shape = "session_id string, opened_at timestamp, resets_at timestamp"
    return times.select("session_id", "t").groupBy("session_id").transformWithStateInPandas(_Tiles(minutes), shape, "Append", "None")
