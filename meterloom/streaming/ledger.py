"""The ledger: records, allowances, their samples, health and checkpoints of one store, changed by commits.

A commit writes what it changes as new Parquet folders and then, last, a manifest that names every folder of its state. A
reader opens one manifest and sees all tables as of that commit; a commit that dies before its manifest has changed
nothing, and what it wrote is named nowhere.

Records are a log. Each commit's folder holds the rows it inserted, updated or deleted (tombstones), with what stood there
before, dealt to buckets by key; a key's newest row counts. A commit reads only the buckets its batch touches. From the
old and new rows come signed sums by hour, source and model and by thread, so that totals are folds of small tables and
read no records. `compact` folds old folders into one.

Writers may meet: a manifest is never written over by a later commit of the same number, unless the last commit is
repeated. Who finds its number taken works out its changes anew against the state that is there now. That rests on a file
system whose rename doesn't write over files, as HDFS' does; on object stores one writer at a time is to be let in.
`vacuum` removes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import packed, unpacked
from ..operators import state
from ..operators.ledger import COUNTS, Filter, capped
from ..operators.series import KEY, pooled
from ..schema import CHECKPOINT, HEALTH, MAX_EXPONENT, QUOTA
from ..sources.paths import DriverFiles

#: Parts that keys are dealt to; a batch reads those it touches.
BUCKETS = 32

#: Drafts up to which a commit sends their keys to the log, not the log's rows to them.
FEW = 100_000

#: Drafts by which a bucket passes the others, if it isn't to be taken for one with a hot key.
HOT = 100_000

#: Rows up to which one task writes a bucket; those of larger commits are written by several.
CELL_ROWS = 250_000

#: How often a commit is worked out anew when other writers are first.
TRIES = 10

#: How long a folder that no manifest names stays: longer than a commit runs, or a reader holds on to a state.
GRACE = timedelta(days=1)

#: What `was` keeps of the row before: enough to take it out of every sum.
WAS = ("content_hash", "event_ts", "model", "session_id", *COUNTS, "amount_minor", "currency", "exponent")
SUMS = ("records", *COUNTS, *(f"{c}_counted" for c in COUNTS), "priced")
HOURS, THREADS, COSTS = ("hour_start", "source_app", "model"), ("source_app", "session_id", "model"), ("hour_start", "source_app", "model", "currency", "exponent")


@dataclass(frozen=True)
class Scope:
    """What a source reports whole: its dated records in [since, until) that a batch doesn't hold are gone.

    Without an adapter or source_ref those of all are meant. Without `since` there is no lower bound.
    """

    source_app: str
    until: datetime
    since: datetime | None = None
    adapter: str | None = None
    source_ref: str | None = None

    def holds(self) -> Column:
        out = (F.col("source_app") == self.source_app) & (F.col("event_ts") < F.lit(self.until).cast("timestamp"))
        if self.since is not None:
            out &= F.col("event_ts") >= F.lit(self.since).cast("timestamp")
        for column in ("adapter", "source_ref"):
            if (wanted := getattr(self, column)) is not None:
                out &= F.col(column) == wanted
        return F.coalesce(out, F.lit(False))


EMPTY = {"commit": 0, "revision": 0, "floor": 0, "at": None, "records": [], "hours": [], "threads": [], "costs": [], "samples": [], "quotas": None, "marks": None, "health": None, "checkpoints": None, "delta": None, "changes": {}, "streams": {}}


def _folders(manifest: dict) -> set[str]:
    """Every folder that a manifest names."""
    held = [manifest[name] for name in ("quotas", "marks", "health", "checkpoints", "delta")]
    return {f for f in held if f} | {f for name in ("records", "hours", "threads", "costs", "samples") for f in manifest[name]}


class State:
    """All tables as of one commit."""

    def __init__(self, ledger: Ledger, manifest: dict):
        self.ledger, self.manifest = ledger, manifest
        self.commit, self.revision = manifest["commit"], manifest["revision"]

    def _read(self, folders: Iterable[str], schema: str | None = None) -> DataFrame | None:
        """The folders as one frame; each keeps its own columns, those it lacks are null."""
        spark, frames = self.ledger.spark, [self.ledger.spark.read.parquet(f"{self.ledger.path}/{f}") for f in folders]
        if not frames:
            return None if schema is None else spark.createDataFrame([], schema)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def log(self) -> DataFrame | None:
        """Every row of the log, tombstones too."""
        return self._read(self.manifest["records"])

    def records(self, columns: Iterable[str] | None = None) -> DataFrame | None:
        """The newest row of each key that isn't deleted, all columns or those named; None before the first commit of records."""
        return newest(self.log(), columns)

    def quotas(self) -> DataFrame:
        return self._read(filter(None, [self.manifest["quotas"]]), QUOTA)

    def samples(self) -> DataFrame:
        return self._read(self.manifest["samples"], QUOTA)

    def health(self) -> DataFrame:
        return self._read(filter(None, [self.manifest["health"]]), HEALTH).drop("material")

    def checkpoints(self) -> DataFrame:
        return self._read(filter(None, [self.manifest["checkpoints"]]), CHECKPOINT)

    def _folded(self, name: str, by: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame | None:
        partial = self._read(self.manifest[name])
        if partial is None:
            return None
        return partial.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums)).filter(F.col(sums[0]) != 0)

    def hours(self) -> DataFrame | None:
        """Sums by hour, source and model, from the signed sums of all commits."""
        return self._folded("hours", HOURS, SUMS)

    def totals(self, *by: str, wanted: Filter | None = None) -> DataFrame | None:
        """The columns of `operators.ledger.totals`, without a look at a record. Date bounds must be whole hours."""
        hours = self.hours()
        if hours is None:
            return None
        return hours.filter(_whole_hours(wanted)).groupBy(*by).agg(*_total_columns())

    def costs(self, *by: str, wanted: Filter | None = None) -> DataFrame | None:
        """Exact sums of each currency, at the largest exponent that any of its records has."""
        costs = self._folded("costs", COSTS, ("counted", "amount"))
        if costs is None:
            return None
        scale = lambda e: F.pow(F.lit(10), MAX_EXPONENT - e).cast("decimal(10,0)")
        summed = costs.filter(_whole_hours(wanted)).groupBy(*by, "currency").agg(F.sum(F.col("amount").cast("decimal(28,0)") * scale(F.col("exponent"))).alias("scaled"), F.max("exponent").alias("exponent"), F.sum("counted").alias("counted"))
        return summed.select(*by, "currency", capped(F.call_function("div", F.col("scaled"), scale(F.col("exponent")))).alias("amount_minor"), "exponent", "counted")

    def threads(self) -> DataFrame | None:
        """Sums and models of each thread; times and folders of threads are in the records alone."""
        threads = self._folded("threads", THREADS, SUMS)
        if threads is None:
            return None
        models = F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models")  # one row for each model
        return threads.filter("session_id is not null").groupBy("source_app", "session_id").agg(*_total_columns(), models)


def _total_columns() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = [total("records").alias("records")]
    for c in COUNTS:
        out += [capped(F.sum(c)).alias(c), total(f"{c}_counted").alias(f"{c}_counted"), (total("records") - total(f"{c}_counted")).alias(f"{c}_unknown")]
    return [*out, (total("records") - total("priced")).alias("records_without_cost")]


def _whole_hours(wanted: Filter | None) -> Column:
    if wanted is None:
        return F.lit(True)
    if any(t is not None and (t.minute or t.second or t.microsecond) for t in (wanted.since, wanted.until)):
        raise ValueError("sums are kept by the hour: bounds must be whole hours, or the records be asked")
    out = wanted.without_dates()
    for t, late in ((wanted.since, True), (wanted.until, False)):
        if t is not None:
            bound = F.lit(t).cast("timestamp")
            out &= (F.col("hour_start") >= bound) if late else (F.col("hour_start") < bound)
    return out


def newest(log: DataFrame | None, columns: Iterable[str] | None = None) -> DataFrame | None:
    """A key's newest row, where that isn't a tombstone, with all columns or those named. Keys meet by partial aggregation, so
    a long history is no hot key; nothing but the columns named travels."""
    if log is None:
        return None
    names = [c for c in log.columns if c not in ("bucket", "was", "outcome", "deleted")] if columns is None else list(columns)
    met = log.groupBy(packed(F.col("dedupe_key")).alias("key")).agg(F.max_by(F.struct(*(_narrow(c) for c in names if c != "dedupe_key"), F.col("deleted").alias("_deleted")), "revision").alias("r"))
    return met.filter("not r._deleted").select(*(unpacked(F.col("key")).alias(c) if c == "dedupe_key" else _wide(c, f"r.{c}") for c in names))


def _narrow(column: str) -> Column:
    """A column of records as it travels: hashes as bytes."""
    return (packed(F.col(column)) if column == "content_hash" else F.col(column)).alias(column)


def _wide(column: str, of: str) -> Column:
    return (unpacked(F.col(of)) if column == "content_hash" else F.col(of)).alias(column)


def _near(log: DataFrame, kept: DataFrame | None, rows: int, touched: list[int], scopes: list[Scope]) -> DataFrame:
    """The rows of the log that a batch or its scopes may change: of few drafts their keys' rows, of many those of the buckets
    they touch, and all of the sources that scopes name, as a key is of one source."""
    scoped = F.coalesce(F.col("source_app").isin(sorted({s.source_app for s in scopes})), F.lit(False)) if scopes else F.lit(False)
    if kept is None:
        return log.filter(scoped)
    of_batch = F.col("bucket").isin(touched)
    if rows > FEW:
        return log.filter(scoped | of_batch)
    few = log.filter(~scoped & of_batch).join(F.broadcast(kept.select("dedupe_key").distinct()), "dedupe_key", "left_semi")
    return log.filter(scoped).unionByName(few) if scopes else few


def _signed(delta: DataFrame) -> DataFrame:
    """What a delta adds to the sums and, with negative signs, what it takes away."""
    columns = ("source_app", *WAS[1:])
    after = delta.filter("not deleted").select(*columns, F.lit(1).alias("sign"))
    before = delta.filter("was is not null").select("source_app", *(F.col(f"was.{c}").alias(c) for c in WAS[1:]), F.lit(-1).alias("sign"))
    return after.unionByName(before).withColumn("hour_start", F.date_trunc("hour", "event_ts"))


def _sums() -> list[Column]:
    s = F.col("sign")
    each = [F.sum(s).cast("long").alias("records")]
    each += [F.sum(s * F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")).cast("decimal(38,0)").alias(c) for c in COUNTS]
    each += [F.sum(F.when(F.col(c).isNotNull(), s).otherwise(0)).cast("long").alias(f"{c}_counted") for c in COUNTS]
    return [*each, F.sum(F.when(F.col("amount_minor").isNotNull(), s).otherwise(0)).cast("long").alias("priced")]


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = DriverFiles(spark, self.path)

    # manifests -------------------------------------------------------------------------------------------------------
    def commits(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith(".")]

    def last(self) -> int:
        return max(self.commits(), default=0)

    def manifest(self, commit: int) -> dict:
        return EMPTY if commit == 0 else json.loads(self.files.read(f"manifests/{commit:012d}.json"))

    def at(self, commit: int | None = None) -> State:
        """All tables as of a commit, or as of the last one up to it; the last of all if none is named."""
        at = max((n for n in self.commits() if commit is None or n <= commit), default=0)
        found = self.manifest(at)
        if commit is not None and commit < self.manifest(self.last())["floor"]:
            raise ValueError("older than the base")
        return State(self, found)

    def _put(self, manifest: dict, over: bool) -> bool:
        return self.files.swap(f"manifests/{manifest['commit']:012d}.json", json.dumps(manifest), over)

    def _write(self, df: DataFrame, table: str, *partition: str) -> str:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition).parquet(f"{self.path}/{folder}")
        return folder

    def _saved(self, df: DataFrame, table: str, *partition: str) -> tuple[str, DataFrame]:
        folder = self._write(df, table, *partition)
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")

    # reading ---------------------------------------------------------------------------------------------------------
    def _log(self, schema=None) -> DataFrame:
        log = self.at().log()
        return self.spark.createDataFrame([], schema) if log is None else log

    def current(self, schema=None, before: int | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """The current records, or those as of the commits before `before`, none of which may lie in a base; all columns or
        those named."""
        out = self.at(None if before is None else before - 1).records(columns)
        return self.spark.createDataFrame([], schema) if out is None else out

    def changes(self) -> DataFrame:
        """What each commit published of each source: (commit, revision, at, source_app, inserted, updated, deleted, unchanged)."""
        rows = [(m["commit"], m["revision"], m["at"], s, *(n[k] for k in ("inserted", "updated", "deleted", "unchanged"))) for m in map(self.manifest, self.commits()) for s, n in m["changes"].items()]
        out = self.spark.createDataFrame(rows, "commit long, revision long, at string, source_app string, inserted long, updated long, deleted long, unchanged long")
        return out.withColumn("at", F.to_timestamp("at"))

    def holds(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream has been committed."""
        return self.manifest(self.last())["streams"].get(stream, -1) >= batch

    # writing ---------------------------------------------------------------------------------------------------------
    def commit(
        self,
        batch: DataFrame | None,
        revision: int | None = None,
        scopes: Iterable[Scope] = (),
        quotas: DataFrame | None = None,
        replace_quotas_of: str | None = None,
        attempts: DataFrame | None = None,
        checkpoints: DataFrame | None = None,
        at: datetime | None = None,
        stream: tuple[str, int] | None = None,
    ) -> State:
        """Commit number `revision`, the next one if none is given: all of it or nothing. Repeating the last commit puts its
        result in place of the first. `stream` is the name of a stream and the number of its batch, see `holds`.

        `batch`: normalized drafts, the last of a key by (origin, position), then by place in the frame, counts. `scopes` are
        held against all of the batch's keys, so a record that comes unchanged stays. `quotas` are merged with, or with
        `replace_quotas_of` replace those of, what is stored; readings that changed are sampled. `attempts` (source_app,
        outcome, observed_at, awaiting, error), one for each source, move its health; `checkpoints` (adapter, unit, payload)
        replace those of their unit. The state's revision counts commits that changed records, allowances or health.

        Where another writer has taken the number, a commit without a number of its own is worked out again, `TRIES` times.
        """
        scopes, at = list(scopes), datetime.now(UTC) if at is None else at
        for _ in range(TRIES if revision is None else 1):
            if (made := self._commit(batch, revision, scopes, quotas, replace_quotas_of, attempts, checkpoints, at, stream)) is not None:
                return made
        raise ValueError("other writers have been first" if revision is None else f"commit {revision} has been made by another writer")

    def _commit(
        self,
        batch: DataFrame | None,
        revision: int | None,
        scopes: list[Scope],
        quotas: DataFrame | None,
        replace_quotas_of: str | None,
        attempts: DataFrame | None,
        checkpoints: DataFrame | None,
        at: datetime,
        stream: tuple[str, int] | None,
    ) -> State | None:
        """One try; None where another writer has been first."""
        made = self.commits()
        last = max(made, default=0)
        revision = last + 1 if revision is None else revision
        if revision < last or revision < 1:
            raise ValueError(f"commit {last} has been made already")
        before = self.at(max((n for n in made if n < revision), default=0))
        new = dict(before.manifest) | {"commit": revision, "at": at.isoformat(), "delta": None, "changes": {}}
        if stream is not None:
            new["streams"] = new["streams"] | {stream[0]: stream[1]}
        work, advanced = [], False
        if batch is not None or scopes:
            advanced |= self._records(batch, revision, scopes, before, new, work)
        if quotas is not None:
            advanced |= self._quotas(quotas, replace_quotas_of, before, new)
        if attempts is not None:
            health, table = self._saved(state.next_health(before.health(), attempts, at), "health")
            new["health"] = health
            advanced |= not table.filter("material").isEmpty()
        if checkpoints is not None:
            rows = before.checkpoints().withColumn("new", F.lit(0)).unionByName(checkpoints.select("adapter", "unit", "payload").withColumn("new", F.lit(1)))
            new["checkpoints"] = self._write(rows.groupBy("adapter", "unit").agg(F.max_by("payload", "new").alias("payload")), "checkpoints")
        new["revision"] = before.revision + advanced
        put = self._put(new, over=revision == last)
        for folder in work if put else [*work, *(_folders(new) - _folders(before.manifest))]:
            self.files.drop(folder)
        return State(self, new) if put else None

    def _records(self, batch: DataFrame | None, revision: int, scopes: list[Scope], before: State, new: dict, work: list[str]) -> bool:
        """Drafts and stored rows meet in one shuffle, dealt as the delta is written; of stored rows only `WAS` travels, and the
        whole row where a scope holds it."""
        log, kept, rows = before.log(), None, 0
        if log is None and batch is None:
            return False
        hashed = F.xxhash64("dedupe_key")
        bucket, key = F.pmod(hashed, F.lit(BUCKETS)).cast("int"), packed(F.col("dedupe_key")).alias("key")
        sides, columns, touched = [], [], []
        if batch is not None:
            drafts = batch.filter("reject_reason is null").drop("reject_reason")
            columns = [c for c in drafts.columns if c != "dedupe_key"]
            folder, kept = self._saved(drafts.withColumns({"bucket": bucket, "place": F.monotonically_increasing_id()}), "work")
            work.append(folder)
            dealt = dict(kept.groupBy("bucket").agg(F.count("*").alias("n")).collect())  # at most BUCKETS
            rows, touched = sum(dealt.values()), sorted(dealt)
            order = F.struct(*(F.col(c) for c in ("origin", "position") if c in columns), "place").alias("order")
            fresh = kept.select("bucket", hashed.alias("hashed"), key, F.struct(*(_narrow(c) for c in columns)).alias("new"), order)
            if max(dealt.values(), default=0) > 2 * rows / BUCKETS + HOT:  # a key that is drafted again and again
                fresh = fresh.groupBy("bucket", "hashed", "key").agg(F.max_by("new", "order").alias("new"), F.max("order").alias("order"))
            sides.append(fresh)
        stored = []
        if log is not None:
            stored = [c for c in log.columns if c not in ("dedupe_key", "bucket", "was", "outcome", "deleted", "revision")] if scopes else []
            near = _near(log, kept, rows, touched, scopes)
            if rows > FEW or scopes:
                rows += near.count()
            held = [F.when(reduce(Column.__or__, (s.holds() for s in scopes)), F.struct(*stored)).alias("whole")] if scopes else []
            sides.append(near.select(bucket.alias("bucket"), hashed.alias("hashed"), key, F.struct(*map(_narrow, WAS), "deleted", *held).alias("old"), F.col("revision").alias("of")))
        met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
        met = met.withColumn("cell", F.pmod(F.shiftright("hashed", 5), F.lit(1 + rows // (BUCKETS * CELL_ROWS)))).repartition("bucket", "cell")
        latest = ([F.max_by("new", "order").alias("new")] if batch is not None else []) + ([F.max_by("old", "of").alias("old")] if log is not None else [])
        met = met.groupBy("bucket", "cell", "key").agg(*latest)

        there = F.coalesce(~F.col("old.deleted"), F.lit(False)) if log is not None else F.lit(False)
        drafted = F.col("new").isNotNull() if batch is not None else F.lit(False)
        same = F.col("old.content_hash") == F.col("new.content_hash") if log is not None and batch is not None else F.lit(False)
        outcome = F.when(drafted, F.when(~there, "inserted").when(~same | same.isNull(), "updated"))
        if stored:
            outcome = outcome.when(there & F.col("old.whole").isNotNull(), "deleted")
        if log is not None:
            was = F.when(there, F.struct(*(_wide(c, f"old.{c}") for c in WAS)))
        else:
            was = F.lit(None).cast(_was_type(drafts))
        value = lambda c: F.when(drafted, _wide(c, f"new.{c}")).otherwise(F.col(f"old.whole.{c}")) if c in columns and c in stored else _wide(c, f"new.{c}") if c in columns else F.col(f"old.whole.{c}")
        names = [*columns, *(c for c in stored if c not in columns)]
        changed = met.withColumn("outcome", outcome).filter("outcome is not null")
        delta = changed.select("bucket", unpacked(F.col("key")).alias("dedupe_key"), *(value(c).alias(c) for c in names), was.alias("was"), "outcome", (F.col("outcome") == "deleted").alias("deleted"), F.lit(revision).cast("long").alias("revision"))
        folder, delta = self._saved(delta, "records", "bucket")
        counted = {(r["source_app"], r["outcome"]): r["n"] for r in delta.groupBy("source_app", "outcome").agg(F.count("*").alias("n")).collect()}
        seen = {} if kept is None else dict(kept.groupBy("source_app").agg(F.count_distinct(key).alias("n")).collect())
        for source in sorted({s for s, _ in counted} | set(seen)):
            n = {k: counted.get((source, k), 0) for k in ("inserted", "updated", "deleted")}
            new["changes"][source] = n | {"unchanged": seen.get(source, 0) - n["inserted"] - n["updated"]}
        if not counted:
            work.append(folder)
            return False
        signed = _signed(delta)
        new["delta"], new["records"] = folder, [*new["records"], folder]
        new["hours"] = [*new["hours"], self._write(signed.groupBy(*HOURS).agg(*_sums()), "hours")]
        new["threads"] = [*new["threads"], self._write(signed.filter("session_id is not null").groupBy(*THREADS).agg(*_sums()), "threads")]
        amount = F.sum(F.col("sign") * F.col("amount_minor").cast("decimal(20,0)")).cast("decimal(38,0)").alias("amount")
        new["costs"] = [*new["costs"], self._write(signed.filter("amount_minor is not null").groupBy(*COSTS).agg(F.sum("sign").cast("long").alias("counted"), amount), "costs")]
        return True

    def _quotas(self, incoming: DataFrame, of: str | None, before: State, new: dict) -> bool:
        columns = [c.strip().split(" ")[0] for c in QUOTA.split(",")]
        stored = before.quotas()
        new["quotas"], merged = self._saved(state.merged_quotas(stored, incoming.select(*columns), of).select(*columns), "quotas")
        marks = before._read(filter(None, [before.manifest["marks"]]), QUOTA)
        moved = state.changed_samples(merged, marks).select(*columns)
        folder, moved = self._saved(moved, "samples")
        new["samples"] = [*new["samples"], folder]
        # the newest sample of each window, so that the next commit needn't read them all
        rows = pooled(marks).withColumn("new", F.lit(0)).unionByName(pooled(moved).withColumn("new", F.lit(1)))
        kept = [c for c in columns if c not in KEY]
        new["marks"] = self._write(rows.groupBy(*KEY).agg(F.max_by(F.struct(*kept), "new").alias("q")).select("source_app", "window_minutes", "q.*").select(*columns), "marks")
        return not merged.exceptAll(stored.select(*columns)).isEmpty() or not stored.select(*columns).exceptAll(merged).isEmpty()

    # upkeep ----------------------------------------------------------------------------------------------------------
    def compact(self, upto: int) -> None:
        """Folds the folders of the commits up to `upto` into one of each table, for every state from there on.

        The last commit may be repeated, so `upto` lies before it. States before `upto` can no longer be read; the deltas of
        their commits stay, so a reader of changes that has fallen behind still gets them.
        """
        last = self.last()
        if upto >= last:
            raise ValueError("the last revision can't be compacted")
        old = self.at(upto)
        base = {name: [] for name in ("records", "hours", "threads", "costs", "samples")}
        if (records := newest(old.log())) is not None:
            bucket = F.pmod(F.xxhash64("dedupe_key"), F.lit(BUCKETS)).cast("int")
            rows = records.withColumns({"deleted": F.lit(False), "bucket": bucket})
            base["records"] = [self._write(rows.repartition("bucket"), "records", "bucket")]
            for name, by, sums in (("hours", HOURS, SUMS), ("threads", THREADS, SUMS), ("costs", COSTS, ("counted", "amount"))):
                base[name] = [self._write(old._folded(name, by, sums), name)]
        if old.manifest["samples"]:
            base["samples"] = [self._write(old.samples(), "samples")]
        for n in (n for n in self.commits() if n >= old.commit):
            m = self.manifest(n)
            folded = {name: [*base[name], *(f for f in m[name] if f not in set(old.manifest[name]))] for name in base}
            self._put(m | folded | {"floor": upto}, over=True)

    def prune_samples(self, now: datetime, revision: int) -> State:
        """A commit that keeps only the samples of the last days."""
        before = self.at()
        kept = state.pruned_samples(before.samples(), now)
        new = dict(before.manifest) | {"commit": revision, "at": now.isoformat(), "delta": None, "changes": {}, "samples": [self._write(kept, "samples")]}
        if not self._put(new, over=False):
            raise ValueError(f"commit {revision} has been made by another writer")
        return State(self, new)

    def forget(self, upto: int) -> None:
        """Drops the manifests of the commits up to `upto`, which lies before the base, so that `vacuum` can remove what only
        they name. What these commits published is gone with them: a reader of changes that hasn't come so far stops with an
        error and must begin again from a state."""
        if upto >= self.manifest(self.last())["floor"]:
            raise ValueError("only commits before the base can be forgotten")
        self.files.swap("forgotten.json", json.dumps({"upto": max(upto, self.forgotten())}), over=True)
        for n in self.commits():
            if n <= upto:
                self.files.drop(f"manifests/{n:012d}.json")

    def forgotten(self) -> int:
        """The last commit whose changes may be gone."""
        return json.loads(self.files.read("forgotten.json"))["upto"] if self.files.has("forgotten.json") else 0

    def vacuum(self, now: datetime | None = None, grace: timedelta = GRACE) -> list[str]:
        """Removes the folders that no manifest has named for the time of `grace`, and returns their names.

        These are left by commits that died or were repeated and by `compact`. A folder is marked by the first call that finds
        it unnamed and removed by a later one, so commits under way and readers of a state have that long to be done."""
        now = datetime.now(UTC) if now is None else now
        now = now.replace(tzinfo=UTC) if now.tzinfo is None else now
        there = [f"data/{table}/{f}" for table in self.files.names("data") for f in self.files.names(f"data/{table}")]
        named = set().union(*(_folders(self.manifest(n)) for n in self.commits()))  # read after what is there
        marks = json.loads(self.files.read("unnamed.json")) if self.files.has("unnamed.json") else {}
        unnamed = {f: marks.get(f, now.isoformat()) for f in there if f not in named}
        gone = [f for f, since in unnamed.items() if datetime.fromisoformat(since) <= now - grace]
        for f in gone:
            self.files.drop(f)
        self.files.swap("unnamed.json", json.dumps({f: since for f, since in unnamed.items() if f not in set(gone)}), over=True)
        return gone


def _was_type(rows: DataFrame) -> str:
    kinds = dict(rows.dtypes)
    return f"struct<{','.join(f'{c}:{kinds[c]}' for c in WAS)}>"
