"""Links between members of a bucket that its first text leads: they alone come to the sketch test."""

from meterloom.llm import minhash


def family(k, n=900):
    """Three texts of `n` words. The first is like the second to 60 %; the second and third share exactly 75 %."""
    words = [f"f{k}w{i}" for i in range(n)]
    changed = lambda at, tag: " ".join(f"{w}{tag}" if i in at else w for i, w in enumerate(words))
    return changed(set(range(13, 13 + 19 * 45, 19)), "a"), " ".join(words), changed({2, *range(20, 20 + 34 * 25, 34)}, "b")


def similarity(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b), len(a | b), len(a), len(b)


def test_links_at_the_least_similarity_pass_the_sketch(spark, monkeypatch):
    families = [family(k) for k in range(120)]
    both, either, *sizes = similarity(*families[0][1:])
    assert 4 * both == 3 * either and min(sizes) > minhash.SKETCH
    led = similarity(*families[0][:2])
    assert 0.55 < led[0] / led[1] < 0.65
    counted, of = [], minhash._leftover
    monkeypatch.setattr(minhash, "_leftover", lambda buckets, found: counted.append(of(buckets, found).count()) or of(buckets, found))
    rows = [(3 * k + j, t) for k, f in enumerate(families) for j, t in enumerate(f)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert counted[0] > 100
    assert [got[3 * k + 2] for k in range(120)] == [3 * k + 1 for k in range(120)] and all(got[3 * k] == 3 * k for k in range(120))


def test_a_bucket_of_many_components_keeps_every_link(spark, monkeypatch):
    """Blocks smaller than a bucket: members meet over blocks, and pairs that only share the leader's bucket are found."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(30):  # pairs, each like its partner and too far from all others
        own = [f"{w}x{k}" if i % 11 == 3 else w for i, w in enumerate(base)]
        rows += [(2 * k + 1, " ".join(own)), (2 * k + 2, " ".join([*own[:-6], *(f"{w}y" for w in own[-6:])]))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(296)} for i, t in rows}
    want = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = {k: a if c == b else c for k, c in want.items()}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 20
