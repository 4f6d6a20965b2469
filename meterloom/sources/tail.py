"""Lines appended to JSONL logs, as a stream: each file is read on from the byte where the last batch ended.

`spark.readStream.format("log_tail").option("folder", ...).option("pattern", "*.jsonl")` gives file, path, at (the byte a
line starts at, which orders the lines of a file), value. Folders must be mounted where executors run too.

A file is known by device and inode, so a moved one goes on where it was. A line without its newline waits until that
comes. A file that has become shorter is another content and is read from its start. One of the size seen last isn't
opened. Bytes that aren't UTF-8 become replacement characters. Long stretches are parted, by lines, over tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one task, of one step of the search for a newline, and lines of one Arrow batch.
PART_BYTES, STEP, BATCH = 64 << 20, 1 << 16, 4096


@dataclass
class Stretch(InputPartition):
    file: str
    path: str
    begin: int
    end: int
    #: Whether a line starts at `begin`; else the first one belongs to the stretch before.
    whole: bool


def complete(path: str, size: int) -> int:
    """The end of the last complete line in the first `size` bytes."""
    with open(path, "rb") as f:
        while size:
            at = max(0, size - STEP)
            f.seek(at)
            found = f.read(size - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            size = at
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets are {file: {path, size, end, there, begin}}: what a file was when listed, the end of its last complete line,
    whether it was there, and where its lines go on where the offset before doesn't hold the file.

    `places` names a file in which the offset of the last planned batch is kept, so that a reader that starts again knows
    the place and size of every file it has ever seen, of those that are away too. Without it a file that was away when
    the stream started again is read from its start, and every file is opened once.
    """

    def __init__(self, folder: str, pattern: str, part_bytes: int, places: str | None = None):
        self.folder, self.pattern, self.part_bytes, self.places = folder, pattern, part_bytes, places
        self.known: dict[str, dict] = {}
        self.listed: set[str] = set()
        if places is not None and os.path.exists(places):
            self.known = json.loads(Path(places).read_text())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        place = lambda file, end: None if file in self.listed else end
        now = {file: {**seen, "there": False, "begin": place(file, seen["end"])} for file, seen in self.known.items()}
        for path in sorted(map(str, Path(self.folder).rglob(self.pattern))):
            try:
                s = os.stat(path)
                file = f"{s.st_dev}:{s.st_ino}"
                seen = self.known.get(file)
                same = seen is not None and seen["size"] == s.st_size
                end = seen["end"] if same else complete(path, s.st_size)
            except FileNotFoundError:  # gone since it was listed
                continue
            begin = None if seen is None else place(file, 0 if s.st_size < seen["size"] else seen["end"])
            now[file] = {"path": path, "size": s.st_size, "end": end, "there": True, "begin": begin}
        return now

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for file, now in end.items():
            if not now["there"]:
                continue
            first = now["begin"]
            if first is None:
                before = start.get(file, {"size": 0, "end": 0})
                first = 0 if now["size"] < before["size"] else before["end"]
            out += [Stretch(file, now["path"], a, min(a + self.part_bytes, now["end"]), a == first) for a in range(first, now["end"], self.part_bytes)]
        self._keep({**self.known, **start, **end})
        self.listed = set(end)
        return out

    def _keep(self, known: dict) -> None:
        self.known = {file: {c: seen[c] for c in ("path", "size", "end")} for file, seen in known.items()}
        if self.places is not None:
            temporary = f"{self.places}.{os.getpid()}"
            Path(temporary).write_text(json.dumps(self.known))
            os.replace(temporary, self.places)

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        try:
            log = open(part.path, "rb")
        except FileNotFoundError:  # gone since the batch was planned, and its lines with it
            return
        rows: list[tuple[int, str]] = []
        with log as f:
            if part.whole:
                f.seek(part.begin)
            else:
                f.seek(part.begin - 1)
                f.readline()
            while (at := f.tell()) < part.end:
                line = f.readline().rstrip(b"\r\n")
                if line:
                    rows.append((at, line.decode("utf-8", "replace")))
                if len(rows) == BATCH:
                    yield self._batch(part, rows)
                    rows = []
        if rows:
            yield self._batch(part, rows)

    @staticmethod
    def _batch(part: Stretch, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([part.file] * n), pa.array([part.path] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])]
        return pa.RecordBatch.from_arrays(columns, ["file", "path", "at", "value"])

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, path string, at long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["folder"], self.options.get("pattern", "*.jsonl"), int(self.options.get("part_bytes", PART_BYTES)), self.options.get("places"))


def tail(spark: SparkSession, folder: str, pattern: str = "*.jsonl", part_bytes: int = PART_BYTES, places: str | None = None) -> DataFrame:
    """The stream of lines appended to the files of `folder`; `places` is a file of the driver, see `TailReader`."""
    spark.dataSource.register(LogTail)
    options = {"folder": folder, "pattern": pattern, "part_bytes": part_bytes} | ({} if places is None else {"places": places})
    return spark.readStream.format("log_tail").options(**options).load()
