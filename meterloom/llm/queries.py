"""The queries of this subpackage: each applies one operator to its whole table and returns the digest of its result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, importance, katz, minhash, mixing, packing, private, repair, repeats, search, token_files, toxicity
from .common import crc_mod, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "top_segment", "n_passages")


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratio = importance.fit(docs, table(spark, sf_dir, "labels"))
    drawn = importance.resample(docs, ratio)
    return drawn.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_exact": op2_exact,
    "op3_mixing": op3_mixing,
    "op4_katz": op4_katz,
    "op5_token_files": op5_token_files,
    "op6_fingerprints": op6_fingerprints,
    "op7_repeats": op7_repeats,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_importance": op10_importance,
    "op11_search": op11_search,
    "op12_private": op12_private,
    "op13_repair": op13_repair,
}

#: DuckDB SQL of the same rows and columns, where SQL can express them.
ORACLE_SQL = {
    "op2_exact": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256 FROM d),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
}
