"""Appended log lines against what was appended, batch by batch."""

import json
import os

import pytest

from meterloom.sources import logs
from meterloom.sources.tail import TailReader, complete, tail
from meterloom.streaming.ingest import Ledger, ingest_lines


class Steps:
    """A stream's rounds by hand: the values each one reads."""

    def __init__(self, folder, part_bytes=7):
        self.reader, self.start = TailReader(str(folder), "*.jsonl", part_bytes), {}

    def __call__(self):
        end = json.loads(json.dumps(self.reader.latestOffset()))
        parts = self.reader.partitions(self.start, end)
        self.start = end
        return [(at, v) for p in parts for b in self.reader.read(p) for at, v in zip(b.column("at").to_pylist(), b.column("value").to_pylist(), strict=True)]


@pytest.mark.parametrize("part_bytes", [1, 3, 7, 1 << 20])
def test_rounds(tmp_path, part_bytes):
    steps, log = Steps(tmp_path, part_bytes), tmp_path / "a.jsonl"
    assert steps() == []
    log.write_bytes(b"one\n\ntwo\nthr")
    assert steps() == [(0, "one"), (5, "two")]
    assert steps() == []
    with log.open("ab") as f:
        f.write(b"ee\r\n" + b"\xff\n")
    assert steps() == [(9, "three"), (16, "�")]
    (tmp_path / "old").mkdir()
    log.rename(tmp_path / "old/b.jsonl")
    with (tmp_path / "old/b.jsonl").open("ab") as f:
        f.write(b"moved\n")
    assert steps() == [(18, "moved")]
    os.truncate(tmp_path / "old/b.jsonl", 4)
    assert steps() == [(0, "one")]


def test_an_unchanged_file_is_not_opened_and_one_that_is_away_keeps_its_place(tmp_path):
    steps, log = Steps(tmp_path), tmp_path / "a.jsonl"
    log.write_bytes(b"one\n")
    steps()
    log.rename(tmp_path / "a.away")
    assert steps() == []
    (tmp_path / "a.away").rename(log)
    log.chmod(0)
    assert steps() == []


def test_a_new_reader_goes_on_from_the_offset(tmp_path):
    steps, log = Steps(tmp_path), tmp_path / "a.jsonl"
    log.write_bytes(b"one\ntwo")
    steps()
    log.write_bytes(b"one\ntwo\n")
    again = Steps(tmp_path)
    again.start = steps.start
    assert again() == [(4, "two")]


def test_last_newline_of_a_long_line(tmp_path):
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"x\n" + b"y" * 200_000)
    assert complete(str(log), 200_002) == 2 and complete(str(log), 1) == 0


def test_appended_messages_reach_the_ledger(spark, tmp_path):
    line = lambda i, out: json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "assistant", "sessionId": "s", "message": {"id": i, "model": "m", "usage": {"input_tokens": 2, "output_tokens": out}}})
    logs_dir, ledger = tmp_path / "logs", Ledger(spark, str(tmp_path / "ledger"))
    logs_dir.mkdir()

    def run():
        ingest_lines(tail(spark, str(logs_dir), part_bytes=50), logs.transcripts, ledger, str(tmp_path / "checkpoint")).awaitTermination()
        return {r["source_event_id"]: (r["output"], r["revision"]) for r in ledger.current().collect()}

    (logs_dir / "a.jsonl").write_text(line("a", 1) + "\n{broken\n" + line("b", 2) + "\n" + line("c", 3))
    assert run() == {"a": (1, 1), "b": (2, 1)}
    with (logs_dir / "a.jsonl").open("a") as f:
        f.write("\n" + line("a", 9) + "\n")
    assert run() == {"a": (9, 2), "b": (2, 1), "c": (3, 2)}
    assert run() == {"a": (9, 2), "b": (2, 1), "c": (3, 2)}
