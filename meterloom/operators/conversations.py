"""Conversations as token drafts and event drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_drafts(bubbles: DataFrame) -> DataFrame:
    """Folds bubbles (conversation, at, bubble, is_user, model, tokens) to drafts; further columns are kept.

    Replies that carry tokens give a token draft with the last model known so far; a user turn without such a reply
    gives one event draft of unknown size under its own model; other replies are dropped.
    """
    w = Window.partitionBy("conversation").orderBy("at", "bubble").rowsBetween(Window.unboundedPreceding, 0)
    turns = bubbles.withColumns({"turn_no": F.sum(F.col("is_user").cast("int")).over(w), "carried": F.last("model", ignorenulls=True).over(w), "paid": ~F.col("is_user") & (F.col("tokens") > 0)})
    covered = F.max("paid").over(Window.partitionBy("conversation", "turn_no"))
    kept = turns.withColumn("covered", covered).filter(F.col("paid") | (F.col("is_user") & ~F.col("covered")))
    more = [c for c in bubbles.columns if c not in ("conversation", "at", "bubble", "is_user", "model", "tokens")]
    return kept.select("conversation", "at", "bubble", *more, F.when(F.col("paid"), "tokens").otherwise("event").alias("kind"), F.when(F.col("paid"), F.col("carried")).otherwise(F.col("model")).alias("model"), F.when(F.col("paid"), F.col("tokens")).alias("tokens"))
