"""Queries for thread operators and prediction joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import text as tx
from ..operators import dataset as ds
from ..operators import threads as th
from ..sources.tables import table
from .registry import register
from .sqlparts import LABELLED_DOCS


def _sent_sql(text):
    return f"CASE WHEN {text} IS NOT NULL THEN CAST(floor({hz.sql_u01(f'md5({text})', 42, 'sent')} * 3) AS INTEGER) END"


def _ok(spark, c):
    """Simulated scoring failures: about 5% of turns fail."""
    return F.when(hz.u01(F.col("conv_id") * 1000 + F.col("turn"), 42, "ok") < 0.95, th.hashed_sentiment(F.col("text")))


OK_SQL = f"CASE WHEN {hz.sql_u01('conv_id * 1000 + turn', 42, 'ok')} < 0.95 THEN {_sent_sql('text')} END"


@register("j3_predictions_to_rows", f"""
WITH d AS (SELECT doc_id, text FROM documents),
p AS (SELECT doc_id, {_sent_sql('text')} AS prediction FROM d WHERE text IS NOT NULL AND length({tx.sql_clean_text('text')}) > 3)
SELECT d.doc_id, p.prediction FROM d LEFT JOIN p ON p.doc_id = d.doc_id""")
def j3_predictions_to_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    pre = ds.preprocess(d, "en").withColumn("prediction", th.hashed_sentiment(F.col("text")))
    return th.attach_predictions(d.select("doc_id"), pre, "doc_id")


@register("j4_score_distinct_texts", f"""
WITH u AS (SELECT DISTINCT text FROM documents), s AS (SELECT text, {_sent_sql('text')} AS score FROM u)
SELECT d.doc_id, s.score FROM documents d LEFT JOIN s ON s.text = d.text""")
def j4_score_distinct_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return th.score_distinct_texts(d, "text", th.hashed_sentiment).select("doc_id", "score")


@register("j5_reply_parent_link", """
SELECT c.conv_id, c.turn, p.turn AS parent_turn, p.role AS parent_role
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def j5_reply_parent_link(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return th.parent_link(c).select("conv_id", "turn", "parent_turn", "parent_role")


@register("j7_skip_processed", """
WITH k AS (SELECT conv_id, turn, md5(concat_ws('-', role, text, CAST(turn AS VARCHAR))) AS ckey FROM conversations),
h AS (SELECT ckey FROM k WHERE conv_id % 2 = 0)
SELECT conv_id, turn FROM k WHERE ckey NOT IN (SELECT ckey FROM h)""")
def j7_skip_processed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = c.select("conv_id", "turn", F.md5(tx.comment_key(F.col("role"), F.col("text"), F.col("turn").cast("string"))).alias("ckey"))
    history = k.filter(F.col("conv_id") % 2 == 0)
    return th.skip_processed(k, history, "ckey").select("conv_id", "turn")


@register("a23_thread_rollup", f"""
WITH s AS (SELECT conv_id, {OK_SQL} AS sentiment FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS analyzed, CAST(count(sentiment) AS BIGINT) AS successful,
  CAST(count(*) FILTER (WHERE sentiment = 2) AS BIGINT) AS positive, CAST(count(*) FILTER (WHERE sentiment = 1) AS BIGINT) AS neutral,
  CAST(count(*) FILTER (WHERE sentiment = 0) AS BIGINT) AS negative FROM s GROUP BY conv_id""")
def a23_thread_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return th.thread_rollup(c.select("conv_id", _ok(spark, c).alias("sentiment")), "conv_id")


@register("a12_sentiment_tally", f"""
WITH s AS (SELECT role, {OK_SQL} AS sentiment FROM conversations),
r AS (SELECT role, count(*) AS analyzed, count(sentiment) AS successful, count(*) FILTER (WHERE sentiment = 2) AS positive,
  count(*) FILTER (WHERE sentiment = 1) AS neutral, count(*) FILTER (WHERE sentiment = 0) AS negative FROM s GROUP BY role),
t AS (SELECT role, CAST(analyzed AS BIGINT) AS analyzed, CAST(successful AS BIGINT) AS successful,
  CASE WHEN successful > 0 THEN round(positive * 100.0 / successful, 1) ELSE 0.0 END::DOUBLE AS positive_pct,
  CASE WHEN successful > 0 THEN round(neutral * 100.0 / successful, 1) ELSE 0.0 END::DOUBLE AS neutral_pct,
  CASE WHEN successful > 0 THEN round(negative * 100.0 / successful, 1) ELSE 0.0 END::DOUBLE AS negative_pct,
  CAST(CASE WHEN analyzed > 0 THEN round(successful * 100.0 / analyzed) ELSE 0 END AS BIGINT) AS success_rate FROM r)
SELECT *, CASE WHEN success_rate >= 90 THEN 'green' WHEN success_rate >= 70 THEN 'yellow' ELSE 'red' END AS band FROM t""")
def a12_sentiment_tally(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return th.tally(c.select("role", _ok(spark, c).alias("sentiment")), "role")
