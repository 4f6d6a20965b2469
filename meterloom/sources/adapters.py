"""Sources by one protocol: what a source has read since its checkpoints, and a refresh that commits it or its failure.

An adapter returns a `Delta`; `refresh` commits all of it at once with the source's health. A source that can't be reached
is offline, any other failure an error; either leaves records, allowances and checkpoints as they are. Frames are lazy,
so what fails only when it is read counts as the adapter's failure too. `REGISTRY` names the kinds of adapters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_timestamp
from ..operators import state
from ..schema import SOURCES
from ..streaming.ingest import normalized
from ..streaming.ledger import Ledger, Scope, State
from . import logs

#: The kinds of errors of a source; those of `state.UNREACHABLE` mean offline.
KINDS = ("not_implemented", "discovery", "unreadable", "parse", "offline", "rate_limited")
ATTEMPT = "source_app string, outcome string, observed_at timestamp, awaiting boolean, error string"


class SourceError(Exception):
    def __init__(self, kind: str, reason: str, retry_after: float | None = None):
        if kind not in KINDS:
            raise ValueError(f"unknown kind of error: {kind}")
        super().__init__(f"{kind.replace('_', ' ')}: {reason}")
        self.kind, self.retry_after = kind, retry_after

    @property
    def outcome(self) -> str:
        return "offline" if self.kind in state.UNREACHABLE else "failed"


@dataclass
class Delta:
    """What one reading of a source brings; what is None wasn't read and stays."""

    drafts: DataFrame | None = None
    scopes: list[Scope] = field(default_factory=list)
    quotas: DataFrame | None = None
    #: Whether windows of the source that aren't among `quotas` are gone.
    replace_quotas: bool = True
    checkpoints: DataFrame | None = None
    observed_at: datetime | None = None
    awaiting: bool = False


class Adapter(Protocol):
    id: str
    source_app: str
    needs_network: bool

    def read(self, spark: SparkSession, held: State, now: datetime) -> Delta: ...


REGISTRY: dict[str, Callable[..., Adapter]] = {}


def registered(kind: Callable[..., Adapter]) -> Callable[..., Adapter]:
    REGISTRY[kind.id] = kind
    return kind


@registered
@dataclass
class Rollouts:
    """Session rollouts, whole files; appended lines go through `ingest_parsed`."""

    path: str
    id = logs.ROLLOUTS
    source_app = "codex"
    needs_network = False

    def read(self, spark: SparkSession, held: State, now: datetime) -> Delta:
        return Delta(logs.rollout_drafts(spark, self.path), quotas=logs.rollout_quota(spark, self.path))


@registered
@dataclass
class Transcripts:
    """Transcripts and the allowances that they and their cache give."""

    path: str
    cache: str
    id = logs.TRANSCRIPTS
    source_app = "claude_code"
    needs_network = False

    def read(self, spark: SparkSession, held: State, now: datetime) -> Delta:
        return Delta(logs.transcript_drafts(spark, self.path), quotas=logs.allowances_at(spark, self.cache, self.path, now))


@registered
@dataclass
class Billed:
    """Exported pages of billed events. They are all there is of the time they are read again for: what they no longer hold
    is deleted, and placeholders up to the newest billed event go with its arrival."""

    path: str
    reconcile: bool = False
    id = logs.BILLED
    source_app = "cursor"
    needs_network = True

    def read(self, spark: SparkSession, held: State, now: datetime) -> Delta:
        mark = held.checkpoints().filter((F.col("adapter") == self.id) & (F.col("unit") == "published")).select(F.col("payload").cast("timestamp").cast("timestamp_ntz").alias("t")).first()
        since, _ = state.delta_window(None if mark is None else mark["t"], now, self.reconcile)
        drafts = logs.billed_drafts(spark, self.path).withColumn("event_ts", parse_timestamp(F.col("raw_timestamp")))
        drafts = drafts.filter(F.coalesce(F.col("event_ts") >= F.lit(since).cast("timestamp"), F.lit(True)))
        newest = drafts.agg(F.max("event_ts").cast("timestamp_ntz").alias("t")).first()["t"]
        scopes = [Scope(self.source_app, now, since, self.id, "dashboard-window")]
        if newest is not None:
            scopes.append(Scope(self.source_app, newest, None, logs.BUBBLES, logs.LIVE_REF))
        records = held.records()
        awaiting = False
        if records is not None:
            local = records.filter((F.col("source_app") == self.source_app) & (F.col("adapter") == logs.BUBBLES))
            awaiting = state.awaiting_upstream(local, drafts).first()["awaiting_upstream"]
        reached = max((t for t in (newest, None if mark is None else mark["t"]) if t is not None), default=None)
        points = None if reached is None else spark.createDataFrame([(self.id, "published", str(reached))], "adapter string, unit string, payload string")
        return Delta(drafts.drop("event_ts"), scopes, checkpoints=points, observed_at=newest, awaiting=awaiting)


@registered
@dataclass
class Bubbles:
    """Exported conversations; `live` ones are placeholders until they are billed."""

    path: str
    live: bool = False
    id = logs.BUBBLES
    source_app = "cursor"
    needs_network = False

    def read(self, spark: SparkSession, held: State, now: datetime) -> Delta:
        return Delta(logs.bubble_drafts(spark, self.path, self.live))


@registered
@dataclass
class Fixture:
    """A source that gives what it is told to, or fails as it is told to."""

    delta: Delta | SourceError
    source_app: str = SOURCES[0]
    needs_network: bool = False
    id = "fixture"

    def read(self, spark: SparkSession, held: State, now: datetime) -> Delta:
        if isinstance(self.delta, SourceError):
            raise self.delta
        return self.delta


def _attempt(spark: SparkSession, source: str, outcome: str, observed_at: datetime | None = None, awaiting: bool = False, error: str | None = None) -> DataFrame:
    return spark.createDataFrame([(source, outcome, observed_at, awaiting, error)], ATTEMPT)


def refresh(ledger: Ledger, adapter: Adapter, now: datetime) -> State:
    """Reads a source and commits what it brings with its health; a failure commits nothing but that it failed."""
    spark, source = ledger.spark, adapter.source_app
    ledger.commit(None, attempts=_attempt(spark, source, "started"), at=now)
    try:
        d = adapter.read(spark, ledger.at(), now)
        drafts = None if d.drafts is None else normalized(d.drafts)
        done = _attempt(spark, source, "succeeded", d.observed_at, d.awaiting)
        return ledger.commit(drafts, scopes=d.scopes, quotas=d.quotas, replace_quotas_of=source if d.replace_quotas else None, attempts=done, checkpoints=d.checkpoints, at=now)
    except (SourceError, PySparkException, OSError) as e:
        outcome = e.outcome if isinstance(e, SourceError) else "failed"
        return ledger.commit(None, attempts=_attempt(spark, source, outcome, error=str(e).splitlines()[0][:500]), at=now)
