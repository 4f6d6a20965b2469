"""Repair of damaged conversations: cheapest edits that make roles alternate, by a grammar-compressed dynamic program.

A conversation is a sequence of symbols, one for each row: class of its role and fault. A state is what the edited rows
before end in: nothing, a system row, a user row or an assistant row. A symbol is a 4 x 4 matrix in the min-plus algebra
whose entries hold the least cost from state to state and the edits that reach it; Re-Pair rules over the sequences of
all conversations get the product of their parts, once each, and every distinct sequence multiplies rules.

Costs are equal only for as many edits of rows, so of two edit strings of one cost neither goes on from the other by
anything but insertions, which cost more: the ASCII-least one of the parts is part of the ASCII-least whole.

Rows: a null role or text is one space, and so is a null conversation or turn where the damage is drawn. Rows of one turn
come by role, then by the SHA-256 of role and text; equal rows beside each other. An empty table gives an empty result.
Very long conversations are cut into chunks of 1024 rows at most, which any task may hold; only the edits of one
conversation, a string of the result, and a running hash of its texts are made in one task. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch
from .grammar import Rules, compress

#: Costs of edits.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

#: Rows of one chunk; rounds and rules of the grammar; parts that a hot key of a join is dealt over.
CHUNK, ROUNDS, PER_ROUND, SALTS = 1024, 6, 256, 16

#: Symbols: role class, upper case where the text is cut short; x must be deleted. States: nothing, s, u, a.
SYMBOLS = "uasoUASOx"
STATES = ("", "s", "u", "a")
EMITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FINAL = (0, 3)

#: cost and edits from each state to each, None where there is no way
Matrix = list[list[tuple[int, str] | None]]


def _better(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return b if a is None else a if b is None else min(a, b)


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if (x := a[i][k]) is not None:
                for j in range(4):
                    if (y := b[k][j]) is not None:
                        out[i][j] = _better(out[i][j], (x[0] + y[0], x[1] + y[1]))
    return out


def insertions() -> Matrix:
    """Any number of inserted rows, none at the least."""
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for _ in range(3):
        for i in range(4):
            for (k, _initial), j in ((e, to) for e, to in EMITS.items() if e[1] != "s"):
                if (x := out[i][k]) is not None:
                    out[i][j] = _better(out[i][j], (x[0] + INSERT, x[1] + "I"))
    return out


def row_matrix(symbol: str) -> Matrix:
    """One row after any insertions: kept, given another role or deleted."""
    own: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if symbol != "x":
        cut = CUT if symbol.isupper() else 0
        for (i, initial), j in EMITS.items():
            if initial == symbol.lower():
                own[i][j] = _better(own[i][j], (cut, "K"))
            if initial != "s":
                own[i][j] = _better(own[i][j], (REROLE + cut, "R"))
    return product(insertions(), own)


def matrices(rules: Rules) -> list[Matrix]:
    """Of every symbol and, bottom-up, of every rule; each rule is multiplied once."""
    out = [row_matrix(s) for s in SYMBOLS]
    for left, right in rules:
        out.append(product(out[left], out[right]))
    return out


class Track:
    """The cheapest edits from one state to each, over matrices that come one by one, without building strings.

    An entry keeps where it came from; how two entries compare is kept too: -1 or 1 where their edits differ, or how many
    insertions the first has behind the edits of the second.
    """

    def __init__(self, start: int):
        self.cost: list[int | None] = [0 if i == start else None for i in range(4)]
        self.order: dict[tuple[int, int], tuple[int, int]] = {}
        self.back: list[list[tuple[int, str] | None]] = []

    def _compare(self, a: tuple[int, str], b: tuple[int, str]) -> tuple[int, int]:
        x, y, more = a[1], b[1], 0
        if a[0] != b[0]:
            sign, more = self.order[a[0], b[0]]
            if sign:
                return sign, 0
        x, y = ("I" * more + x, y) if more > 0 else (x, "I" * -more + y)
        if x.startswith(y) or y.startswith(x):
            return 0, len(x) - len(y)
        return (-1 if x < y else 1), 0

    def add(self, m: Matrix) -> None:
        cost: list[int | None] = [None] * 4
        back: list[tuple[int, str] | None] = [None] * 4
        for i in range(4):
            if self.cost[i] is None:
                continue
            for j in range(4):
                if (y := m[i][j]) is not None:
                    c = self.cost[i] + y[0]
                    if cost[j] is None or c < cost[j] or (c == cost[j] and self._less((i, y[1]), back[j])):
                        cost[j], back[j] = c, (i, y[1])
        live = [j for j in range(4) if back[j] is not None]
        self.order = {(p, q): self._compare(back[p], back[q]) for p in live for q in live if p != q}
        self.cost = cost
        self.back.append(back)

    def _less(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        sign, more = self._compare(a, b)
        return sign < 0 or (sign == 0 and more < 0)

    def pieces(self, j: int) -> list[str]:
        """The edits of each matrix on the cheapest way to state `j`."""
        out = []
        for back in reversed(self.back):
            j, piece = back[j]
            out.append(piece)
        return out[::-1]


def sequence_matrix(symbols: list[int], of: list[Matrix], starts: tuple[int, ...]) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in starts:
        track = Track(i)
        for s in symbols:
            track.add(of[s])
        out[i] = [None if c is None else (c, "".join(track.pieces(j))) for j, c in enumerate(track.cost)]
    return out


def best_edits(parts: list[Matrix]) -> tuple[int, str]:
    """Least cost of a whole conversation, given in parts, and its ASCII-least edits."""
    track = Track(0)
    for m in (*parts, insertions()):
        track.add(m)
    ends = [j for j in FINAL if track.cost[j] is not None]
    best = ends[0]
    for j in ends[1:]:
        if track.cost[j] < track.cost[best] or (track.cost[j] == track.cost[best] and track._less(track.back[-1][j], track.back[-1][best])):
            best = j
    return track.cost[best], "".join(track.pieces(best))


# rows ----------------------------------------------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage; a dropped one has no copies and an empty text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text = F.when(k.isin(0, 1), "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def _hash(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def marked(rows: DataFrame) -> DataFrame:
    """`rows` without texts: class of role, blank, cut short, hash of role and text."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE.decode())), -1, 1)
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", "turn", "role", F.when(initial.isin("u", "a", "s"), initial).otherwise("o").alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), _hash(F.col("role"), F.col("text")).alias("h"), "copies"
    )


_CHUNK = "conv_id {id}, part long, seq long, symbols string, inner boolean, blank long, duplicate long, truncated long, illegal long, head string, tail string, turns long, low {turn}, high {turn}"
_LEGAL = {"su", "ua", "au"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}


def _chunks(ids: pa.DataType, turns: pa.DataType):
    """Sorted rows as chunks: a conversation's rows of one partition, at most `CHUNK` to a piece."""
    names = [c.split(" ")[0] for c in _CHUNK.split(", ")]
    types = [ids, pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), turns, turns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done = TaskContext.get().partitionId(), 0, []
        now: dict | None = None
        before = None

        def start(conv, inner):
            return {"conv_id": conv, "part": part, "seq": seq, "symbols": [], "inner": inner, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "head": "", "tail": "", "turns": 0, "low": None, "high": None}

        def batch_of(rows):
            for r in rows:
                r["symbols"] = "".join(r["symbols"])
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for conv, turn, initial, blank, cut, h, copies, repeat in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "blank", "cut", "h", "copies", "repeat")), strict=True):
                if now is None:
                    now = start(conv, True)
                elif now["conv_id"] != conv:
                    done.append(now)
                    seq += 1
                    now = start(conv, False)
                for _ in range(copies):
                    if len(now["symbols"]) == CHUNK:
                        now["inner"] = True
                        done.append(now)
                        seq += 1
                        now = start(conv, True)
                    seen = repeat or before == (conv, turn, h)
                    before = (conv, turn, h)
                    fault = "blank" if blank else "duplicate" if seen else "truncated" if cut else None
                    if fault:
                        now[fault] += 1
                    now["symbols"].append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
                    now["illegal"] += bool(now["tail"]) and now["tail"] + initial not in _LEGAL
                    now["head"] = now["head"] or initial
                    now["tail"] = initial
                    if turn is not None:
                        now["turns"] += now["high"] != turn
                        now["low"] = turn if now["low"] is None else now["low"]
                        now["high"] = turn
            if len(done) > 4096:
                yield batch_of(done)
                done = []
        if now is not None:
            now["inner"] = True
            done.append(now)
        if done:
            yield batch_of(done)

    return run


_RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _conversations(ids: pa.DataType):
    """Chunks of whole conversations, in order, as one row for each."""
    names = [c.split(" ")[0] for c in _RESULT.split(", ")]
    types = [ids, *[pa.int64()] * 6, pa.string()]

    def finish(now: dict) -> dict:
        now["gaps"] = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        now["cost"], now["audit"] = best_edits(now.pop("parts"))
        return now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)
        for batch in batches:
            for r in batch.to_pylist():
                part = None
                if r["costs"] is not None:
                    flat = [None if c is None else (c, e) for c, e in zip(r["costs"], r["edits"], strict=True)]
                    part = [flat[4 * i : 4 * i + 4] for i in range(4)]
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        done.append(finish(now))
                    now = {k: r[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "tail", "turns", "low", "high")} | {"parts": []}
                else:
                    for k in ("blank", "duplicate", "truncated", "illegal"):
                        now[k] += r[k]
                    now["illegal"] += bool(now["tail"] and r["head"]) and now["tail"] + r["head"] not in _LEGAL
                    now["tail"] = r["tail"] or now["tail"]
                    if r["low"] is not None:
                        now["turns"] += r["turns"] - (now["high"] == r["low"])
                        now["low"] = r["low"] if now["low"] is None else now["low"]
                        now["high"] = r["high"]
                if part is not None:
                    now["parts"].append(part)
            if len(done) > 1024:
                yield batch_of(done)
                done = []
        if now is not None:
            done.append(finish(now))
        if done:
            yield batch_of(done)

    return run


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits."""
    last = ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text


def _hashed(ids: pa.DataType):
    """Each conversation's row followed by its texts as its row with the hash of the repaired texts, which stream by."""
    names = [c.split(" ")[0] for c in _RESULT.split(", ")] + ["repaired_sha256"]
    types = [ids, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, last, any_row, sha, done = None, 0, "", False, None, []

        def emit(role, text):
            nonlocal any_row, last
            sha.update(((b"\n" if any_row else b"") + f"{role}:{text}".encode()))
            any_row, last = True, role[:1]

        def insert():
            nonlocal at
            while at < len(now["audit"]) and now["audit"][at] == "I":
                at += 1
                emit("assistant" if last == "u" else "user", "")

        def finish():
            insert()
            done.append(now | {"repaired_sha256": sha.hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if r["own"] == 0:
                    if now is not None:
                        finish()
                    now, at, last, any_row, sha = r, 0, "", False, hashlib.sha256()
                    continue
                for _ in range(r["copies"]):
                    insert()
                    edit = now["audit"][at]
                    at += 1
                    if edit == "K":
                        emit(r["role"], r["text"])
                    elif edit == "R":
                        emit("assistant" if last == "u" else "user", r["text"])
            if len(done) > 1024:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], t) for n, t in zip(names, types, strict=True)], names)
                done = []
        if now is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], t) for n, t in zip(names, types, strict=True)], names)

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table: faults, least cost, edits and the hash of the repaired rows.

    Rows travel twice: without texts, in ranges of conversation and turn, for the edits; with texts, once, to be hashed.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = damaged(conversations)
    id_type, turn_type = (dict(conversations.dtypes)[c] for c in ("conv_id", "turn"))
    ids, turns = _ARROW[id_type], _ARROW[turn_type]
    small = marked(rows)
    # the first turn of rows whose role and text come again; copies meet before the shuffle
    firsts = small.filter("copies > 0").groupBy("conv_id", "h").agg(F.min(F.struct("turn")).alias("first"), F.sum("copies").alias("n")).filter("n > 1").drop("n")
    firsts = scratch.save(firsts, "firsts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    f, salt = firsts.alias("f"), F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")
    r = small.withColumn("salt", salt).alias("r")
    joined = r.join(f, F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.h") == F.col("f.h")) & (F.col("r.salt") == F.col("f.salt")), "left")
    repeat = F.col("f.first").isNotNull() & ~F.col("r.turn").eqNullSafe(F.col("f.first.turn"))
    order = ["conv_id", "turn", "role", "h"]
    flat = joined.select("r.conv_id", "r.turn", "r.role", "r.initial", "r.blank", "r.cut", "r.h", "r.copies", repeat.alias("repeat"))
    ordered = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = scratch.save(ordered.mapInArrow(_chunks(ids, turns), _CHUNK.format(id=id_type, turn=turn_type)), "chunks")

    # each distinct sequence once
    numbers = F.expr(f"transform(split(symbols, ''), s -> instr('{SYMBOLS}', s) - 1)").cast("array<int>")
    distinct = scratch.save(chunks.filter("symbols <> ''").select("symbols", "inner").distinct().select(F.col("symbols").alias("key"), "inner", numbers.alias("symbols")), "distinct")
    packed, rules = compress(distinct, scratch, len(SYMBOLS), ROUNDS, PER_ROUND)
    of = matrices(rules)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = batch.column("inner").to_pylist()
            each = [sum(sequence_matrix(s, of, (0, 1, 2, 3) if i else (0,)), []) for s, i in zip(batch.column("symbols").to_pylist(), inner, strict=True)]
            costs = pa.array([[None if x is None else x[0] for x in m] for m in each], pa.list_(pa.int64()))
            edits = pa.array([[None if x is None else x[1] for x in m] for m in each], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("inner"), costs, edits], ["symbols", "inner", "costs", "edits"])

    tables = scratch.save(packed.mapInArrow(evaluate, "symbols string, inner boolean, costs array<long>, edits array<string>"), "matrices")
    salted = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_tables = chunks.withColumn("salt", F.pmod(F.xxhash64("conv_id", "seq"), F.lit(SALTS)).cast("int")).join(salted, ["symbols", "inner", "salt"], "left")
    whole = with_tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    result = scratch.save(whole.mapInArrow(_conversations(ids), _RESULT.format(id=id_type)), "edits")

    # texts meet the edits of their conversation, which sort before them
    none = F.lit(None)
    texts = rows.filter("copies > 0").withColumns({"own": F.lit(1), "h": _hash(F.col("role"), F.col("text"))} | {c: none.cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": none.cast("string")})
    heads = result.withColumns({"own": F.lit(0), "turn": none.cast(turn_type), "role": none.cast("string"), "text": none.cast("string"), "copies": F.lit(0), "h": none.cast("binary")})
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "own", "turn", "role", "h")
    return stream.mapInArrow(_hashed(ids), _RESULT.format(id=id_type) + ", repaired_sha256 string")
