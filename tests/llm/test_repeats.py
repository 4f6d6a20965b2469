"""Repeated 200-byte strings against a count of every window."""

import hashlib
import random
from collections import Counter

from meterloom.llm.repeats import remove_repeats


def brute(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[s : s + 200] for _, r in raws for s in range(len(r) - 199))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - 199):
            if seen[r[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(r, gone) if not g)
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéx ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    rows = [(k, text(rng.randint(0, 200))) for k in range(40)]
    rows += [(100 + k, text(20) + rng.choice(shared) + text(20)) for k in range(40)]
    near = text(300).split(" ")
    for k in range(20):
        own = list(near)
        own[rng.randrange(len(own))] = f"edit{k}"
        rows.append((200 + k, " ".join(own)))
    rows += [(300, "a" * 1500), (301, "ab" * 400), (302, None), (303, ""), (304, "x" * 199), (305, "y" * 200), (306, "y" * 200), (307, rows[0][1]), (0, rows[0][1]), (None, rows[5][1]), (308, text(40_000))]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, remove_repeats(df, **options).collect()), key=str)


def test_matches_every_window_counted(spark):
    rows = made(1)
    assert run(spark, rows) == brute(rows)


def test_groups_in_blocks(spark):
    rows = made(2)
    assert run(spark, rows, block=4) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "z" * 250, 5, "q")], "doc_id long, text string, row long, spans string")
    assert [r["n_removed"] for r in remove_repeats(df).collect()] == [250]
