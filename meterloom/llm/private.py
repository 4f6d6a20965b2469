"""Personal data found by shape and, from there, by context: bootstrapped extraction in DataFrame operations alone.

Strict expressions give the base spans, which are the seeds. Looser ones give candidates: spelled-out or defanged
addresses, numbers that a strict match had swallowed together with their neighbours, telephone numbers without a country
code. Every seed and candidate is an instance, known by kind and normalized text, and stands in lexical patterns: its
shape, the word before, the two words before, the words before and after. The graph of patterns and instances is scored
in rounds: a pattern by the share of its distinct instances that is known, weighed by their scores; an instance that is no
seed by the best of its trusted patterns. Instances that end above the threshold are found, wherever they stand.

Scores are millionths in whole numbers, so that reruns agree. Positions are code points. A null text is an empty one;
rows of one id are told apart by their own number, a null id is returned as it is. Very long texts are one row and their
matches are one row each; candidates that overlap a base span or an earlier candidate are dropped. Hot patterns and
instances are counted before they are shuffled and salted where they are joined. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_and_text

KINDS = ("email", "ip", "card", "phone")

#: Strict expressions. \G and the look-behinds only skip starts from which no match can begin; nothing is tried twice.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser ones; each match must look like its kind once it is normalized.
_DOT, _AT = r"(?:\x20?[\[(](?:dot|\.)[\])]\x20?|\x20dot\x20|\.)", r"(?:\x20?[\[(](?:at|@)[\])]\x20?|\x20at\x20|@)"
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(](?:dot|\.)[\])]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9-])",
    "phone": r"(?<![0-9+(-])(?:00[1-9][0-9]{0,2}[\x20-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}

#: Rounds of scoring; known instances a pattern needs; least trust of a pattern and of an instance, in millionths.
ROUNDS, SUPPORT, TRUST, ONE = 3, 3, 800_000, 1_000_000
#: Characters of context looked at on either side, and parts that a hot key of a join is dealt over.
CONTEXT, SALTS = 80, 16


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _number_fits(kind: str, c: Column) -> Column:
    """Whether a match is one of its kind: parts of at most 255, 13 to 19 digits by Luhn, 9 to 15 digits."""
    if kind == "ip":
        return ~c.rlike(r"(?:^|\.)0*+(?:[1-9][0-9]{3}|25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})")
    if kind == "card":
        return F.length(_digits(c)).between(13, 19) & F.call_function("luhn_check", _digits(c))
    if kind == "phone":
        return F.length(_digits(c)).between(9, 15)
    return F.lit(True)


def normalized(kind: Column, match: Column) -> Column:
    """The instance behind a match: digits of numbers, addresses in lower case with their marks written out."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(match), r"\x20?[\[(](?:dot|\.)[\])]\x20?|\x20dot\x20", "."), r"\x20?[\[(](?:at|@)[\])]\x20?|\x20at\x20", "@")
    return F.when(kind.isin("card", "phone"), _digits(match)).otherwise(plain)


def matches(texts: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """(row, kind, start, end, match, left, right) of every match that fits, of `texts` (row, text).

    The parts between matches give positions and contexts, so no match is looked up again.
    """
    may = {"email": F.col("text").rlike("@|[ \\[(]at[ \\])]"), "ip": F.col("text").rlike("[0-9]"), "card": F.col("text").rlike("[0-9]"), "phone": F.col("text").rlike("[0-9]")}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.when(may[k], F.regexp_extract_all("text", F.lit(e), F.lit(0))).alias("found")) for k, e in expressions.items()))
    some = texts.select("row", "text", F.explode(each).alias("m")).select("row", "text", "m.kind", "m.found").filter(F.size("found") > 0)
    parts = F.lit(None).cast("array<string>")
    for k, e in expressions.items():
        parts = F.when(F.col("kind") == k, F.split("text", e)).otherwise(parts)
    # a generator, so that what it makes is made once
    cut = some.select("row", "kind", F.explode(F.array(F.struct("found", parts.alias("parts")))).alias("c")).select("row", "kind", "c.found", "c.parts")
    after = F.slice("parts", F.lit(2), F.size("parts"))
    rows = cut.select("row", "kind", F.posexplode(F.arrays_zip(F.col("found"), F.col("parts"), after.alias("after"))).alias("at", "m"))
    rows = rows.filter("m.found is not null").select("row", "kind", "at", F.col("m.found").alias("match"), F.length("m.parts").alias("gap"), F.substring("m.parts", -CONTEXT, CONTEXT).alias("left"), F.substring("m.after", 1, CONTEXT).alias("right"))
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    fits = F.lit(False)
    for k in expressions:
        fits = F.when(F.col("kind") == k, _number_fits(k, normalized(F.col("kind"), F.col("match")) if k == "ip" else F.col("match"))).otherwise(fits)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    return placed.filter(fits).select("row", "kind", "start", "end", "match", "left", "right")


def patterns() -> Column:
    """The lexical patterns that an instance stands in; words in lower case, digits as 0."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    before, two, after = (F.regexp_extract(plain(F.col(c)), e, 1) for c, e in (("left", r"(?:^|\s)(\S++)\s*$"), ("left", r"(?:^|\s)(\S++\s++\S++)\s*$"), ("right", r"^\s*+(\S++)")))
    shape = F.regexp_replace(plain(F.col("match")), r"\p{L}+", "a")
    named = lambda name, *parts: F.concat_ws("\x1f", F.lit(name), "kind", *parts)
    every = F.array(named("shape", shape), F.when(before != "", named("before", before)), F.when(two != "", named("two", two)), F.when((before != "") & (after != ""), named("around", before, after)))
    return F.array_compact(every)


def _salted_join(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """`many` with the columns of `few`, one row for each key; a hot key's rows are dealt over `SALTS` parts."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    dealt = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", salt).join(dealt, [key, "salt"]).drop("salt")


def found_instances(spans: DataFrame, scratch: Scratch) -> DataFrame:
    """The instances that candidates may stand for: seeds found loosely elsewhere, and those that end above the threshold.

    `spans` has instance, seed, patterns.
    """
    edges = spans.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min("seed").alias("strict"))
    edges = scratch.save(edges, "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    scores = edges.filter("seed").select("pattern", F.lit(ONE).cast("long").alias("score"))
    for n in range(ROUNDS):
        known = scores.groupBy("pattern").agg(F.sum("score").alias("known"))
        trusted = known.join(sizes, "pattern").withColumn("trust", F.expr("known div size")).filter((F.col("known") >= SUPPORT * ONE) & (F.col("trust") >= TRUST)).select("pattern", "trust")
        trusted = scratch.save(trusted, f"trusted-{n}")
        reached = _salted_join(edges.filter("not seed"), trusted, "pattern", "instance").groupBy("instance").agg(F.max("trust").alias("score"))
        reached = scratch.save(reached, f"reached-{n}")
        if n + 1 < ROUNDS:
            scores = edges.filter("seed").select("pattern", F.lit(ONE).cast("long").alias("score")).unionByName(_salted_join(edges.filter("not seed"), reached, "instance", "pattern").select("pattern", "score"))
    return edges.filter("seed and not strict").select("instance").distinct().unionByName(reached.filter(F.col("score") >= TRUST).select("instance"))


def _listed(spans: Column) -> Column:
    """kind:start:end, joined, in the order of kinds, then of starts."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): base spans by kind, their hash, all spans, and
    how many of these the contexts have added."""
    scratch = Scratch(docs.sparkSession, "private")
    texts = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    texts = scratch.save(texts.select("row", "doc_id", "text"), "texts")
    base = matches(texts, BASE).withColumn("seed", F.lit(True))
    loose = matches(texts, LOOSE).withColumn("seed", F.lit(False))
    spans = scratch.save(base.unionByName(loose), "spans")
    # candidates clear of base spans and of earlier candidates
    w = Window.partitionBy("row").orderBy("start", F.desc("seed"), "end", "kind")
    back = Window.partitionBy("row").orderBy(F.desc("start"), "seed", F.desc("end"), F.desc("kind"))
    past, ahead = w.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    met = (F.col("start") < F.coalesce(F.max("end").over(past), F.lit(-1))) | (F.col("end") > F.coalesce(F.min(F.when(F.col("seed"), F.col("start"))).over(ahead), F.col("end")))
    instance = F.concat_ws(":", "kind", normalized(F.col("kind"), F.col("match")))
    clear = spans.withColumn("met", met).filter("seed or not met").select("row", "kind", "start", "end", "seed", instance.alias("instance"), patterns().alias("patterns"))
    clear = scratch.save(clear, "clear")
    found = _salted_join(clear.filter("not seed"), found_instances(clear, scratch), "instance", "row")
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(kind_no.alias("kind_no"), "start", "end", "seed")
    kept = clear.filter("seed").select("row", span.alias("s")).unionByName(found.select("row", span.alias("s")))
    lists = kept.groupBy("row").agg(F.collect_list("s").alias("s"))
    out = texts.select("row", "doc_id").join(lists, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<kind_no:int,start:long,end:long,seed:boolean>>")))
    out = out.withColumn("base", F.filter("s", lambda x: x["seed"]))
    kinds = F.transform("base", lambda x: x["kind_no"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS, 1)]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"), (F.size("s") - F.size("base")).cast("long").alias("n_found"))
