"""Private data: base spans against plain expressions, and what contexts and shapes find."""

import hashlib
import re

from meterloom.llm import private
from meterloom.llm.queries import op12_private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def plain(text):
    text = text or ""
    tests = (("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15))
    return [(k, m.start(), m.end()) for k, e, ok in tests for m in e.finditer(text) if ok(m.group())]


def check(rows, docs):
    """Base columns of each row against the plain version; base spans are among all spans."""
    want = sorted(((d, tuple(sum(s[0] == k for s in spans) for k in private.KINDS), hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()) for d, t in docs for spans in [plain(t)]), key=str)
    assert sorted(((r["doc_id"], tuple(r[f"n_{k}"] for k in private.KINDS), r["base_sha256"]) for r in rows), key=str) == want
    base = {d: {"%s:%d:%d" % s for s in plain(t)} for d, t in docs}
    for r in rows:
        listed = [s for s in r["spans"].split(",") if s]
        assert len(listed) == len(set(listed)) == sum(r[f"n_{k}"] for k in private.KINDS) + r["n_found"]
        if list(d for d, _ in docs).count(r["doc_id"]) == 1:
            assert base[r["doc_id"]] <= set(listed)
        order = [(private.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in listed]
        assert order == sorted(order)


def test_base_spans_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op12_private(spark, sf_dir).collect()
    check(rows, docs)
    assert sum(r["n_email"] for r in rows) > 0


AWKWARD = [
    "a@b.c_d@e.f g@h i@j. k@l..m x.@-.-", "@a.b a@@b.c +@+.+", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.0255 1.2.3 1..2.3.4 00000000000000000255.1.1.1 1.2.3.99999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111 4 1 1 1", "12 4111111111111111 99", "+1 (523) 555-5810, +1 2 +123456789 +1234567890123456 +1-2-3-4-5-6-7-8-9- +1()9", "++49 30 1234567+49 30 7654321",
    "é\U0001f600 mail: ü.a@b.de \U0001f600 9.9.9.9", None, "", " ", "a" * 6000, "a." * 3000 + "@b.c", "x@" + "y." * 20_000 + "z", "1 " * 30_000, "1." * 30_000, "+1" * 20_000, "a@b.c " * 3000, "1" * 5000, "\n@\n1.1.1.1\n",
]


def test_base_spans_awkward_texts(spark):
    docs = list(enumerate(AWKWARD)) + [(None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS kind", "2 AS spans")
    check(private.find(df).collect(), docs)
    assert private.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_contexts_find_unseen(spark):
    """Known addresses behind one phrase make it a pattern; what else stands there is found, also where it stands alone."""
    docs = [(k, f"Please write to user{k}@mail.example.org today.") for k in range(12)]
    docs += [(100, "Please write to kim [at] mail [dot] example [dot] org today."), (101, "Lee saw kim [at] mail [dot] example [dot] org again."), (102, "We met joe at home dot com parties.")]
    docs += [(200 + k, f"number {k} card 4{k:02d}111111111111{c} there") for k in range(10, 40) for c in "0123456789" if luhn(f"4{k:02d}111111111111{c}")]
    docs += [(300, "in 17 4111111111111111 99 rows")]
    rows = {r["doc_id"]: r for r in private.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    check(list(rows.values()), docs)
    assert rows[100]["spans"] == "email:16:53" and rows[101]["spans"] == "email:8:45"
    assert (rows[102]["spans"], rows[300]["spans"]) == ("", "card:6:22")
    assert all(r["n_found"] == 0 for d, r in rows.items() if d < 100)
