"""Each operator against a brute-force version, a round trip or held-out figures, and on the awkward rows all share."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterloom.llm import exact_dedup, fingerprints, importance, katz, minhash, mixing, packing, radix, token_files, toxicity
from meterloom.llm.common import Scratch, table
from meterloom.llm.components import components

AWKWARD = [(1, None, None), (2, "", "b"), (3, " \n\t", "a"), (4, "one two", "a"), (5, "One  TWO", "a"), (6, "one two", None), (7, "a b c d e f g", "b"), (8, "é'' <|endoftext|> x" * 30, "b"), (-1, "a <|endoftext|> b <|ENDOFTEXT|> c<|startoftext|>", "b"), (9, "w " * 30_000, "c"), (None, "no id", "c")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, s, "x", 5) for i, t, s in AWKWARD], "doc_id long, text string, source string, key string, n long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def shingles(text):
    words = bytes(text, "utf-8").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(sets):
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and min(len(sets[a]), len(sets[b])) * 100 >= 75 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in sets}


def test_minhash_on_documents(documents):
    sets = {i: shingles(t) for i, t in texts(documents).items()}
    want = brute_components(sets)
    for r in minhash.near_duplicates(documents).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_minhash_leftovers_of_one_bucket(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    want = brute_components(sets)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_awkward(awkward, empty):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(awkward).collect()}
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 1, 3]
    assert got[5]["component_id"] == got[6]["component_id"] == 4
    assert got[None]["component_id"] is None
    assert minhash.near_duplicates(empty).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k != 30] + [(5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {k: (0 if k <= 30 else 31) for k in range(61)}


def test_exact_dedup(documents, awkward, empty):
    for df in (documents, awkward):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t.encode().translate(None, b" \t\n\x0b\x0c\r")].append((-len(t), i is None, i or 0, i))
        want = sorted(((i, min(g)[3], len(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for *_, i in g), key=str)
        for options in ({}, {"trie_bytes": 2000}):
            got = exact_dedup.exact_dedup(df, **options).collect()
            assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_trie_spills_and_keeps_all_owners():
    rng = random.Random(3)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(3000)]
    trie, want = radix.RadixTrie(4000), {}
    for i, k in enumerate(keys):
        trie.insert(k, (len(k), i, 1))
        want[k] = radix.better(want[k], (len(k), i, 1)) if k in want else (len(k), i, 1)
    assert dict(trie.items()) == want


def test_mixing(documents, awkward, empty):
    rows = mixing.mix(documents).collect()
    assert sorted(map(tuple, mixing.mix(documents).collect())) == sorted(map(tuple, rows))
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(size)
    want = brute_targets([size[s] for s in order], Fraction(3, 2) * sum(size.values()))
    sizes = defaultdict(list)
    for r in rows:
        sizes[r["source"]].append((r["size"], r["rate"]))
    for s, t in zip(order, want, strict=True):
        assert abs(target[s] - float(t)) < 1e-6
        assert abs(taken[s] - float(t)) <= max(n for n, _ in sizes[s])
        # the tilt: of all rates with these tokens and this cap, the ones nearest to one
        mean, low, high = max(1.0, size[s] / len(sizes[s])), -60.0, 60.0
        rate = lambda n, a, mean=mean: min(2.0, float(np.exp(min(50.0, a * n / mean))))
        for _ in range(100):
            a = (low + high) / 2
            low, high = (a, high) if sum(n * rate(n, a) for n, _ in sizes[s]) < float(t) else (low, a)
        if 0 < t < 2 * size[s]:
            assert all(abs(x - rate(n, a)) < 1e-4 for n, x in sizes[s] if n)
    assert len(mixing.mix(awkward).collect()) == len(AWKWARD)
    assert mixing.mix(empty).collect() == []


def brute_targets(sizes, budget):
    """Shares by weight 3, 1, 2, capped at twice the size, what is over shared again until none is."""
    fixed, weight = {}, lambda k: (3, 1, 2)[k % 3]
    while True:
        rest, total = budget - sum(fixed.values()), sum(weight(k) for k in range(len(sizes)) if k not in fixed)
        over = [k for k in range(len(sizes)) if k not in fixed and rest * weight(k) > 2 * sizes[k] * total]
        if not over:
            return [fixed[k] if k in fixed else rest * weight(k) / total for k in range(len(sizes))]
        fixed |= {k: Fraction(2 * sizes[k]) for k in over}


def test_mixing_of_many_sources(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(0, 9), f"s{k % 400:03d}") for k in range(2000)]
    got = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want = brute_targets([size[s] for s in sorted(size)], Fraction(3, 2) * sum(size.values()))
    assert all(abs(got[s] - float(t)) < 1e-6 for s, t in zip(sorted(size), want, strict=True))


def test_repeat_documents_without_ids_or_with_repeated_ones(spark, awkward, empty):
    again = awkward.union(awkward).union(spark.createDataFrame([(4, f"word {k}", "a", "y", k) for k in range(20)] + [(None, f"none {k}", "b", "y", k) for k in range(20)], awkward.schema))
    key = lambda r: (str(r["doc_id"]), r["text"] or "", str(r["source"]), r["n"])
    given, want = Counter(map(key, again.collect())), mixing.mix(again).agg({"copies": "sum"}).first()[0]
    got = Counter(map(key, mixing.repeat_documents(again).collect()))
    assert sum(got.values()) == want
    assert all(n <= 2 * given[k] for k, n in got.items())
    assert any(k[0] == "None" for k in got)
    # each source's words follow its target
    for r in mixing.mix(again).groupBy("source").agg({"target": "max", "size": "max"}).collect():
        taken = sum(n * len(k[1].split()) for k, n in got.items() if k[2] == str(r["source"]))
        assert abs(taken - r["max(target)"]) <= r["max(size)"]
    assert mixing.repeat_documents(empty).collect() == []


def test_katz(documents, awkward, empty):
    raw = {i: t.encode().lower().split() for i, t in texts(documents).items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in raw}
    counts = Counter(w for i in raw if not held[i] for w in [*raw[i], None])
    n, v = sum(counts.values()), len(counts)
    mine = base = 0.0
    for r in katz.katz_scores(documents).collect():
        tokens = [*raw[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-6 * len(tokens)
        assert np.isfinite(r["score"])
        if r["held_out"]:
            mine, base = mine + r["score"], base + r["base_score"]
    assert mine > base
    assert len(katz.katz_scores(awkward).collect()) == len(AWKWARD)
    assert katz.katz_scores(empty).collect() == []


def test_katz_contexts_sum_to_one():
    rng = np.random.default_rng(1)
    size = 30
    pairs = rng.poisson(0.4, (size, size)) * rng.integers(1, 9, (size, size))
    pairs[5] = pairs[5] * 10  # nothing to discount
    pairs[6] = 7  # followed by every class
    pairs[:, katz.START] = 0
    unigrams = pairs.sum(0) + 1
    unigrams[katz.UNKNOWN] = 0
    d = katz.good_turing([int((pairs == r).sum()) for r in range(1, 7)])
    p = katz.Katz(unigrams, d, *np.zeros((3, size))).p
    off = np.where(pairs <= katz.DISCOUNTED, d[np.minimum(pairs, katz.DISCOUNTED)], 1.0) * pairs
    model = katz.Katz(unigrams, d, off.sum(1), pairs.sum(1).astype(float), ((pairs > 0) * p).sum(1))
    w = np.array([k for k in range(size) if k != katz.START])
    assert abs(p[w].sum() - 1) < 1e-9 and (p[w] > 0).all()
    for v in range(size):
        total = (10 ** model.log10(np.full(len(w), v), w, pairs[v][w])).sum()
        assert abs(total - 1) < 1e-9, v


def test_katz_every_word_has_its_own_bigrams(documents):
    raw = {i: [katz.START, *t.encode().lower().split(), katz.END] for i, t in texts(documents).items()}
    train = [x for i, x in raw.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    ones, pairs = Counter(w for x in train for w in x[1:]), Counter(p for x in train for p in zip(x, x[1:], strict=False))
    counts = {(v, w): c for (v, w), c in pairs.items()} | {((), w): c for w, c in ones.items()}
    d = {n: katz.good_turing([sum(c == r for c in of.values()) for r in range(1, 7)]) for n, of in ((1, ones), (2, pairs))}
    context, seen, covered = Counter(), Counter(), Counter()

    def lower(v, w):  # the end of the recursion is an even share of all words and the unknown one
        return 1 / (len(ones) + 1) if v == () else p((), w)

    def off(v, c):
        return d[1 if v == () else 2][c] if c <= katz.DISCOUNTED else 1

    def p(v, w):
        if not context[v]:
            return lower(v, w)
        short = context[v] - seen[v] < 0.5
        if c := counts.get((v, w), 0):
            return c * off(v, c) * ((context[v] - 0.5) / seen[v] if short else 1) / context[v]
        return (0.5 if short else context[v] - seen[v]) / context[v] / (1 - covered[v]) * lower(v, w)

    for unigram in (True, False):  # the weights of bigrams need the unigrams
        for (v, w), c in counts.items():
            if (v == ()) == unigram:
                context[v] += c
                seen[v] += c * off(v, c)
                covered[v] += lower(v, w)
    assert abs(sum(p((), w) for w in [*ones, katz.UNKNOWN]) - 1) < 1e-9

    for r in katz.katz_scores(documents).collect():
        x = raw[r["doc_id"]]
        assert abs(r["score"] - sum(np.log10(p(v, w)) for v, w in zip(x, x[1:], strict=False))) < 1e-6 * len(x)


def test_token_files(spark, documents, awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for df, options in ((documents, {"file_bytes": 100_000}), (awkward, {})):
        start, want = 0, []
        for i, t in sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = token_files.round_trip(df, path, end_id=0, **options).collect()
        assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert token_files.round_trip(empty, path, end_id=0).collect() == []


def test_token_file_reads_one_document_and_sees_damage(tmp_path):
    at = tmp_path / "x"
    with at.open("wb") as out:
        writer = token_files.TokenFileWriter(out)
        for k in range(50):
            writer.add(k, np.arange(k, k + 5000, dtype=np.uint32))
        writer.close()
    with at.open("rb") as file:
        assert (token_files.TokenFile(file).document(33) == np.arange(33, 5033)).all()
    raw = bytearray(at.read_bytes())
    raw[100] ^= 255
    at.write_bytes(raw)
    with at.open("rb") as file, pytest.raises(Exception):  # noqa: B017
        token_files.TokenFile(file).frame(0)


def test_fingerprints(documents, awkward, empty):
    rows = sorted(texts(documents).items())
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents, part_bytes=50_000).collect()}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = (t[: len(t) - n] + following[:n]) if n else t
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", following)):
            a, b = set(fingerprints.digests(t).tolist()), set(fingerprints.digests(other).tolist())
            assert abs(r[name] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[t].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len(fingerprints.fingerprints(awkward).collect()) == len(AWKWARD)
    assert fingerprints.fingerprints(empty).collect() == []


def test_packing(documents, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (documents, awkward):
        ids = defaultdict(list)
        for r in df.collect():
            ids[r["doc_id"]].append(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
        pieces, sequences = defaultdict(list), defaultdict(list)
        rows = packing.pack_documents(df, path, end_id=1).collect()
        assert len({r["step_group"] for r in rows}) == len({(r["tier"], r["step_group"]) for r in rows})
        for r in rows:
            (own,) = ids[r["doc_id"]]
            assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(own)
            pieces[r["doc_id"]].append((r["start"], r["length"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert pieces.keys() == ids.keys()
        for i, parts in pieces.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == len(ids[i][0])
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048 and at & (at - 1) == 0
        groups, costs = defaultdict(lambda: defaultdict(int)), defaultdict(int)
        for r in rows:
            costs[r["sequence_id"]] += r["length"] ** 2
            groups[r["tier"], r["step_group"]][r["sequence_id"]] += r["length"] ** 2
        for tier in {t for t, _ in groups}:
            own = [g for (t, _), g in groups.items() if t == tier]
            n = [len(g) for g in own]
            assert max(n) <= packing.GROUP and max(n) - min(n) <= 1
            total = [sum(g.values()) / len(g) for g in own]
            assert max(total) - min(total) <= max(c for g in own for c in g.values())
    assert packing.pack_documents(empty, path, end_id=1).collect() == []


def test_segments_against_every_segment():
    rng = random.Random(5)
    for _ in range(200):
        weights = [rng.choice([0, 0, 0, 2.0, 3.0]) for _ in range(rng.randint(1, 25))]
        at = [k for k, w in enumerate(weights) if w]
        found = toxicity.segments(at, [weights[k] for k in at], -1.0)
        value = [w or -1.0 for w in weights]
        best = max((sum(value[a:z]) for a in range(len(value)) for z in range(a + 1, len(value) + 1)), default=0)
        if at:
            assert abs(max(s for *_, s in found) - best) < 1e-9
            assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    clean, bad = [f"word{k}" for k in range(300)], ["vileword", "nastyword", "hatefulword", "crudeword"]
    docs, labels = [], []
    for i in range(600):
        own = [rng.choice(clean) for _ in range(rng.randint(0, 80))]
        if toxic := i % 6 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = [rng.choice(bad) for _ in range(4)]
        docs.append((i, " ".join(own)))
        labels.append((i, 0, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, y)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert 0 < model.scale < 10 and 0 < model.rate < 10
    for i, text in docs:  # a score by its definition, from the best of all runs of words
        words = text.encode().lower().split()
        weight = [next((model.weights[t] for t in toxicity.forms(w) if t in model.weights), 0.0) or model.miss for w in words]
        runs = [sum(weight[a:z]) for a in range(len(words)) for z in range(a + 1, len(words) + 1)] if i % 29 == 0 else []
        if runs and max(runs) > 0:
            x = model.rate * max(runs) - np.log(model.scale * len(words))
            others = toxicity.evidence(len(words), [s for *_, s in toxicity.located(words, toxicity.Hits(model.weights), model)[2]], model)
            assert others[1] > 1 or abs(got[i] - 1 / (1 + np.exp(-(model.bias + model.slope * max(-20.0, min(60.0, x)))))) < 1e-9
    wrong = [i for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0 and (got[i] >= 0.5) != bool(t)]
    assert not wrong
    assert toxicity.drop_toxic(d, model).count() == 500


def test_toxicity_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, none)
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(awkward, model).collect())
    assert toxicity.score(empty, model).collect() == []


def test_importance(spark, documents, awkward, empty, sf_dir):
    ratio = importance.fit(documents, table(spark, sf_dir, "labels"))
    rows = importance.resample(documents, ratio).collect()
    keys = sorted((r["key"] for r in rows), reverse=True)
    k = int(len(rows) * 0.75)
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in rows if r["key"] >= keys[k - 1]}
    # log weights against plain counts of every word and pair
    hashes, raw = importance.WordHashes(), {i: t.encode() for i, t in texts(documents).items()}
    good = {r["doc_id"] for r in table(spark, sf_dir, "labels").filter("quality = 1").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    own = {i: importance.features(t, hashes) for i, t in raw.items()}
    assert all(len(own[i]) == max(0, 2 * len(t.split()) - 1) for i, t in raw.items())
    model = []
    for ids in (raw.keys() & good, raw.keys()):
        n = np.ones(importance.BUCKETS)
        for i in ids:
            np.add.at(n, own[i], 1)
        model.append(np.log(n / n.sum()))
    for r in rows:
        assert abs(r["log_weight"] - (model[0] - model[1])[own[r["doc_id"]]].sum()) < 1e-6 and r["n_grams"] == len(own[r["doc_id"]])
    assert importance.kth_largest(spark.createDataFrame([(float(x % 1000),) for x in range(20_000)], "v double"), "v", 7777, bins=16, few=10) == float(sorted((x % 1000 for x in range(20_000)), reverse=True)[7776])
    assert len(importance.resample(awkward, ratio).collect()) == len(AWKWARD)
    assert importance.resample(empty, ratio).collect() == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert after.columns == columns
        if name == "exact_dedup":
            stripped = [bytes(t, "utf-8").translate(None, b" \t\n\x0b\x0c\r") for t in texts(after).values()]
            assert len(set(stripped)) == len(stripped)
        if name == "near_dedup":
            sets = {i: shingles(t) for i, t in texts(docs).items()}
            assert {r["doc_id"] for r in after.collect()} == set(brute_components(sets).values())
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_awkward_rows(spark, awkward, empty, sf_dir):
    """Null and repeated ids, null, empty, equal and long texts, and clashing columns go through every stage."""
    import corpus_pipeline

    names = {"key": "row", "n": "copies"}  # names that the stages use themselves
    df = awkward.union(awkward).withColumnsRenamed(names).withColumn("_row", F.lit(1)).withColumn("copy", F.lit(2)).withColumn("gone", F.lit(3)).withColumn("label_id", F.lit(4))
    df = df.union(spark.createDataFrame([(4, "other words here", "a", "x", 5, 1, 2, 3, 4), (None, "no id", "c", "x", 5, 1, 2, 3, 4)], df.schema))
    rows = {name: stage for name, stage in corpus_pipeline.STAGES}
    bare = lambda r: (r["doc_id"], (r["text"] or "").encode().translate(None, b" \t\n\x0b\x0c\r"))

    clean = rows["toxicity"](spark, df, sf_dir)
    assert clean.columns == df.columns and clean.count() == df.count()
    once = rows["exact_dedup"](spark, df, sf_dir).collect()
    assert Counter(bare(r)[1] for r in once) == Counter({bare(r)[1] for r in df.collect()})
    assert {r["doc_id"] for r in once} == {3, 4, 5, 7, 8, 9, -1, None}
    near = rows["near_dedup"](spark, df, sf_dir)
    assert near.columns == df.columns and {r["doc_id"] for r in near.collect()} == {None, -1, 1, 2, 3, 4, 7, 8, 9}
    mixed = rows["mixing"](spark, df, sf_dir)
    given = Counter(map(bare, df.collect()))
    assert mixed.columns == df.columns and all(n <= 2 * given[k] for k, n in Counter(map(bare, mixed.collect())).items())
    packed = rows["packing"](spark, df, sf_dir).filter("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in packed} == Counter(r["doc_id"] for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name


def test_minhash_texts_that_share_an_id(spark):
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "x"])), (1, " ".join(b)), (3, " ".join([*b[:-1], "y"])), (0, " ".join(b)), (9, "alone")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (9, 9)}


def test_minhash_measured_recall(spark):
    """Pairs at the least similarity of a link, on both sides of the sketch size: at most one in a thousand is missed."""
    rng = random.Random(11)
    rows = []
    for k in range(400):
        n = 104 if k < 300 else 900
        own = [f"w{k}.{j}" for j in range(n)]
        edits = 0
        while True:  # as many scattered edits as a link allows
            other = list(own)
            for at in range(3, 3 + 9 * (edits + 1), 9):
                other[at % n] = f"e{k}.{at}"
            if 100 * len(shingles(" ".join(own)) & shingles(" ".join(other))) < 75 * len(shingles(" ".join(own)) | shingles(" ".join(other))):
                break
            edits, best = edits + 1, other
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(best))]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] != 2 * k for k in range(400)) == 0
