"""Ranked search against scores computed document by document, and on awkward rows."""

import math
import re

import pytest

from meterloom.llm import search
from meterloom.llm.queries import op11_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(d, t) for d, text in docs if (t := terms(text))]
    if not counted:
        return []
    n_docs, n_terms = len(counted), sum(len(t) for _, t in counted)
    held = [(d, len(t), {x: t.count(x) for x in set(t)}) for d, t in counted]
    df = {}
    for _, _, c in held:
        for x in c:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        wanted = terms(text)
        weight = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(x, 0) + 1))) for x in wanted}
        scored = []
        for d, n, c in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(weight[x] * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in wanted if x in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, d, -s))
    return sorted(out, key=str)


def mine(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_whole_tables(spark, sf_dir):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    got = mine(op11_search(spark, sf_dir))
    assert len(got) >= 400 and got == plain(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


DOCS = [(1, "Ab ab cd"), (2, "ab, AB; cd."), (3, None), (4, ""), (5, "--- ..."), (6, "é É ab cd x_y"), (None, "ab ab cd"), (7, "Ab ab cd"), (7, "Ab ab cd"), (8, "k" * 70_000 + " cd"), (9, "ab " * 20_000), (10, "a\x7fb\u0080c 12:34")]
ITEMS = [(1, "AB ab cd"), (1, "cd"), (2, None), (None, "é 12 x y"), (3, "..."), (4, "nothing here"), (5, "ab cd ab cd"), (6, "k" * 70_000)]


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_search_awkward_rows(spark, monkeypatch, block):
    """Nulls, ties, repeated ids and rows, long texts, clashing names, several blocks of items, texts in pieces."""
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "PIECE", 1000)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS row", "2 AS score").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "3 AS row", "'y' AS doc_id")
    for k in (1, 3, 10):
        assert mine(search.search(docs, items, k=k)) == plain(DOCS, ITEMS, k)


def test_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert mine(search.search(docs, some)) == mine(search.search(docs, items)) == []
    assert mine(search.search(spark.createDataFrame(DOCS, "doc_id long, text string"), items)) == []


def test_pieces_of_a_text(monkeypatch):
    text = " ".join(f"w{k % 70}" for k in range(5000)).encode()
    whole = search.term_counts(text)
    monkeypatch.setattr(search, "PIECE", 37)
    assert search.term_counts(text) == whole
