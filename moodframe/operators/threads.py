"""Comment-thread operators (J3, J4, J5, J7, A12, A23) and the stand-in
text scorer used where a model's output is needed without training one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hz


def hashed_sentiment(text: Column) -> Column:
    """Deterministic stand-in scorer: a class from md5(text); null text -> null."""
    return F.when(text.isNotNull(), F.floor(hz.u01(F.md5(text), 42, "sent") * 3).cast("int"))


def attach_predictions(rows: DataFrame, scored: DataFrame, key: str, pred_col: str = "prediction") -> DataFrame:
    """Predictions back onto the input rows by key (left join); rows the
    scoring step dropped get null."""
    return rows.join(scored.select(key, pred_col), key, "left")


def score_distinct_texts(df: DataFrame, text_col: str, scorer) -> DataFrame:
    """Score each distinct text once and join the score back by the text's
    128-bit digest, so that no text is a shuffle key. A null text has no score."""
    d = df.withColumn("_th", F.md5(text_col))
    uniq = d.where(F.col(text_col).isNotNull()).groupBy("_th").agg(F.first(text_col).alias("_text"))
    scored = uniq.select("_th", scorer(F.col("_text")).alias("score"))
    return d.join(scored, "_th", "left").drop("_th")


def parent_link(turns: DataFrame, thread: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Each turn linked to the previous turn of its thread (self left
    join on (thread, pos - 1))."""
    parent = turns.select(F.col(thread), (F.col(pos) + 1).alias(pos), F.col("role").alias("parent_role"),
                          F.col(pos).alias("parent_turn"))
    return turns.join(parent, [thread, pos], "left")


def skip_processed(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the processed history (left anti join)."""
    return rows.join(history.select(key).distinct(), key, "left_anti")


def thread_rollup(scored: DataFrame, group: str) -> DataFrame:
    """Per thread: analyzed, successful, positive/neutral/negative."""
    s = F.col("sentiment")
    return scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("analyzed"),
        F.count(s).alias("successful"),
        F.count(F.when(s == 2, 1)).alias("positive"),
        F.count(F.when(s == 1, 1)).alias("neutral"),
        F.count(F.when(s == 0, 1)).alias("negative"))


def tally(scored: DataFrame, group: str) -> DataFrame:
    """Sentiment tally with 1-decimal percentages, success rate
    round(100*ok/analyzed) (0 when none) and its colour band."""
    r = thread_rollup(scored, group)
    pct = lambda c: F.when(F.col("successful") > 0, F.round(F.col(c) * 100.0 / F.col("successful"), 1)).otherwise(F.lit(0.0))
    rate = F.when(F.col("analyzed") > 0, F.round(F.col("successful") * 100.0 / F.col("analyzed"))).otherwise(F.lit(0.0)).cast("bigint")
    return r.select(group, "analyzed", "successful", pct("positive").alias("positive_pct"), pct("neutral").alias("neutral_pct"),
                    pct("negative").alias("negative_pct"), rate.alias("success_rate")).withColumn(
        "band", F.when(F.col("success_rate") >= 90, "green").when(F.col("success_rate") >= 70, "yellow").otherwise("red"))
