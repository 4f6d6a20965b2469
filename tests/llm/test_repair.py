"""Repaired conversations against a plain dynamic program over whole strings, and on awkward rows."""

import hashlib
import heapq
import random
import zlib

import pandas as pd
import pytest

from meterloom.llm import repair
from meterloom.llm.common import Scratch
from meterloom.llm.grammar import compress
from meterloom.llm.queries import op13_repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_edits(symbols):
    """Least (cost, edits) of (initial, must go, cut), by states kept as whole strings."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def spread(states):
        queue = [(c, e, s) for s, (c, e) in states.items()]
        heapq.heapify(queue)
        out = {}
        while queue:
            c, e, s = heapq.heappop(queue)
            if s in out:
                continue
            out[s] = (c, e)
            for (a, i), b in legal.items():
                if a == s and i != "s":
                    heapq.heappush(queue, (c + 3, e + "I", b))
        return out

    states = {"": (0, "")}
    for initial, gone, cut in symbols:
        after = {}

        def put(s, entry):
            after[s] = min(after.get(s, entry), entry)

        for s, (c, e) in spread(states).items():
            put(s, (c + 4, e + "D"))
            if not gone:
                for (a, i), b in legal.items():
                    if a == s and i == initial:
                        put(b, (c + 3 * cut, e + "K"))
                    if a == s and i != "s":
                        put(b, (c + 3 + 3 * cut, e + "R"))
        states = after
    states = spread(states)
    return min(states[s] for s in ("", "a") if s in states)


def plain(rows):
    """What the contract says, for rows (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        named = lambda x: " " if x is None else str(x)
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, mine in held.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        mine.sort(key=key)
        seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") or not a[0] or not b[0] for a, b in zip(symbols, symbols[1:]))
        cost, audit = plain_edits(symbols)
        texts, rest, last = [], iter(mine), ""
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(rest)
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                texts.append(f"{role}:{text}")
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def mine(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_repair_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert mine(op13_repair(spark, sf_dir)) == plain(rows)


def random_rows(seed, n_conv, length):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n_conv)]:
        for _ in range(rng.randint(1, length)):
            rows.append((conv, rng.choice([None, *range(length)]), rng.choice(["user", "assistant", "system", "tool", "", None, "ubik"]), rng.choice([None, "", " \n", "a.", "b", "Is it?  ", "c!\x0b", f"t{rng.randint(0, 9)}.", "x" * 3000])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_awkward_rows(spark, seed):
    rows = random_rows(seed, 60, 14)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "'x' AS copies", "0L AS part")
    assert mine(repair.repair(df)) == plain(rows)


def test_repair_hot_conversation(spark, monkeypatch):
    """A conversation over several partitions and chunks, with one text in a third of its rows."""
    monkeypatch.setattr(repair, "CHUNK", 16)
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), "same text." if rng.random() < 0.3 else f"text {t}{rng.choice('.?,')}") for t in range(3000)]
    rows += random_rows(4, 5, 8)
    assert mine(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(9))) == plain(rows)


def test_repair_empty(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = mine(repair.repair(spark.createDataFrame([(dropped, 0, "user", "a.")], SCHEMA)))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_rules_are_products(spark):
    """Matrices of rules, entry by entry, against the plain program over the symbols they stand for."""
    rng = random.Random(5)
    sequences = [[rng.randrange(9) for _ in range(rng.randint(1, 30))] for _ in range(80)]
    df = spark.createDataFrame(pd.DataFrame({"k": range(80), "symbols": sequences}), "k long, symbols array<int>")
    packed, rules = compress(df, Scratch(spark, "test"), 9, 4, 20)
    of = repair.matrices(rules)

    def spelled(s):
        return [s] if s < 9 else [x for part in rules[s - 9] for x in spelled(part)]

    assert rules
    for r in packed.collect():
        assert [x for s in r["symbols"] for x in spelled(s)] == sequences[r["k"]]
        names = [repair.SYMBOLS[s] for s in sequences[r["k"]]]
        want = plain_edits([(n.lower(), n == "x", n.isupper()) for n in names])
        assert repair.best_edits([of[s] for s in r["symbols"]]) == want
        assert repair.best_edits([repair.sequence_matrix(r["symbols"], of, (0, 1, 2, 3))]) == want
