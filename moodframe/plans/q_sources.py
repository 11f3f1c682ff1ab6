"""Queries for sources and sinks: data derived from the given tables is
written to a fresh folder under the shared checkpoint directory, read back
through the reader under test, and compared with SQL over the source
tables."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import text as tx
from ..operators import dataset as ds
from ..session import scratch_path
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources.tables import table
from .q_text import RAW_LABELLED_SQL, _raw_labelled, _sql_coerce
from .registry import register
from .sqlparts import LABELLED_DOCS


def _csv(df, name, sep=","):
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("quoteAll", True).csv(path)
    return path


@register("s1_strict_labeled_csv", f"""WITH r AS ({RAW_LABELLED_SQL})
SELECT md5({tx.sql_py_strip('text')}) AS text_md5, {_sql_coerce('label', False)} AS label FROM r
WHERE {_sql_coerce('label', False)} IS NOT NULL""")
def s1_strict_labeled_csv(spark, sf_dir):
    raw = _raw_labelled(spark, sf_dir).select("text", "label", "doc_id")
    path = _csv(raw, "s1", sep=";")
    return rd.read_labeled(spark, path, multiline=True).select(F.md5("text").alias("text_md5"), "label")


@register("s2_s4_plain_csv", f"""WITH d AS ({LABELLED_DOCS}) SELECT md5(text) AS text_md5, CAST(label AS VARCHAR) AS label FROM d""")
def s2_s4_plain_csv(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir).select("text", F.col("label").cast("string"))
    path = _csv(d, "s2")
    missing = rd.read_manual(spark, path + "-missing")
    return rd.read_manual(spark, path, multiline=True).unionByName(missing).select(F.md5("text").alias("text_md5"), "label")


@register("s3_processed_by_language", "SELECT doc_id FROM documents WHERE lang = 'en'")
def s3_processed_by_language(spark, sf_dir):
    path = scratch_path(spark, "s3")
    table(spark, sf_dir, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    return rd.read_processed(spark, path, "en").select("doc_id")


@register("s5_manual_import_quotas", f"""WITH d AS ({LABELLED_DOCS}),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42', 'quota')), doc_id) AS rn FROM d)
SELECT doc_id AS row_id, label AS sentiment FROM r WHERE rn <= CASE label WHEN 0 THEN 30 WHEN 1 THEN 30 WHEN 2 THEN 30 END""")
def s5_manual_import_quotas(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text", "label")
    return rd.collect_manual(d, {0: 30, 1: 30, 2: 30}).select("row_id", "sentiment")


S6_QUOTAS = {0: 40, 1: 25, 2: 10_000}


@register("s6_app_reviews", """
WITH r AS (SELECT doc_id, text, CAST(CASE WHEN 1 + doc_id % 5 > 3 THEN 2 WHEN 1 + doc_id % 5 < 3 THEN 0 ELSE 1 END AS INTEGER) AS s FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42', 'quota')), doc_id) AS rn FROM r)
SELECT doc_id AS row_id, s AS sentiment, md5(text) AS text_md5 FROM k WHERE rn <= CASE s WHEN 0 THEN 40 WHEN 1 THEN 25 ELSE 10000 END""")
def s6_app_reviews(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("content"),
                                                 (1 + F.col("doc_id") % 5).cast("int").alias("score"))
    return rd.reviews_to_rows(d, S6_QUOTAS).select("row_id", "sentiment", F.md5("text").alias("text_md5"))


def _market_json(spark, sf_dir):
    """One JSON response per source: ratings built from its documents, with
    a missing star every 7th document and a blank comment every 11th."""
    d = table(spark, sf_dir, "documents")
    star = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(1 + F.col("doc_id") % 5)
    comment = F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.col("text"))
    # One response page per (source, block of 50 documents): pages are bounded.
    r = d.groupBy("source", (F.col("doc_id") / 50).cast("long").alias("page")).agg(
        F.collect_list(F.struct(star.cast("int").alias("rating_star"), comment.alias("comment"))).alias("ratings"))
    return r.select("source", "page", F.to_json(F.struct(F.struct("ratings").alias("data"))).alias("json"))


@register("s7_y9_marketplace_json", """
SELECT source, text,
  CAST(CASE WHEN doc_id % 7 = 0 THEN 0 WHEN 1 + doc_id % 5 > 3 THEN 2 WHEN 1 + doc_id % 5 < 3 THEN 0 ELSE 1 END AS INTEGER) AS label
FROM documents WHERE doc_id % 11 <> 0 AND regexp_replace(text, '^[\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+|[\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+$', '', 'g') <> ''""")
def s7_marketplace_json(spark, sf_dir):
    """Paginated per-source response documents (at most 50 ratings each)."""
    j = _market_json(spark, sf_dir).withColumnRenamed("source", "src")
    return rd.flatten_marketplace(j, "json", "src").select(F.col("src").alias("source"), "text", "label")


@register("s8_thread_json", """
SELECT conv_id, CAST(turn AS INTEGER) AS pos, coalesce(CASE WHEN turn % 5 = 4 THEN NULL ELSE text END, '') AS text FROM conversations""")
def s8_thread_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    msg = F.when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(F.col("text"))
    # One thread page per (conversation, block of 50 turns).
    j = c.groupBy("conv_id", (F.col("turn") / 50).cast("long").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("turn", msg.alias("message")))).alias("d"))
    j = j.select("conv_id", "page", F.to_json(F.struct(F.transform("d", lambda x: F.struct(x.getField("message").alias("message"))).alias("data"))).alias("json"))
    f = rd.flatten_thread(j.withColumn("k", F.struct("conv_id", "page")), "json", "k")
    return f.select(F.col("k.conv_id").alias("conv_id"), (F.col("k.page") * 50 + F.col("pos")).cast("int").alias("pos"), "text")


@register("s9_u2_union_files", f"""
SELECT doc_id, CAST(label AS VARCHAR) AS label, NULL::VARCHAR AS lang FROM ({LABELLED_DOCS})
UNION ALL SELECT doc_id, NULL, lang FROM documents""")
def s9_union_files(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir)
    p1 = _csv(d.select(F.col("doc_id").cast("string"), F.col("label").cast("string")), "s9a")
    p2 = _csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "lang"), "s9b")
    u = rd.union_files(spark, [p1, p2])
    return u.select(F.col("doc_id").cast("bigint"), "label", "lang")


@register("s10_word_list", """
SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)""")
def s10_word_list(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))
    b = words.select(F.concat(F.lit("  "), "w", F.lit(" ")).alias("value"))
    path = scratch_path(spark, "s10")
    b.write.mode("overwrite").text(path)
    return rd.read_word_list(spark, path)


@register("s11_synonyms", """
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: t <> '') AS ws FROM benchmark)
SELECT ws[1] AS word, CAST(len(ws) - 1 AS INTEGER) AS n_synonyms, array_to_string(ws[2:], ',') AS synonyms FROM w WHERE len(ws) >= 2""")
def s11_synonyms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(
        F.array_join(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t != ""), ",").alias("value"))
    path = scratch_path(spark, "s11")
    b.write.mode("overwrite").text(path)
    s = rd.read_synonyms(spark, path)
    return s.select("word", F.size("synonyms").alias("n_synonyms"), F.array_join("synonyms", ",").alias("synonyms"))


@register("s13_metric_snapshot", """
SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id""")
def s13_metric_snapshot(spark, sf_dir):
    """Per client, a snapshot document with parallel arrays (request times,
    latencies), written as JSON, read back and exploded."""
    e = table(spark, sf_dir, "events")
    # One snapshot per (client, block of 100 events): bounded documents.
    snap = e.groupBy("user_id", (F.col("event_id") / 100).cast("long").alias("blk")).agg(
        F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.col("value").alias("v"), "event_id")).alias("x"))
    snap = snap.select("user_id", F.transform("x", lambda s: s.getField("t")).alias("requests"),
                       F.transform("x", lambda s: s.getField("v")).alias("response_times"))
    path = scratch_path(spark, "s13")
    snap.write.mode("overwrite").json(path)
    back = spark.read.schema("user_id LONG, requests ARRAY<STRING>, response_times ARRAY<DOUBLE>").json(path)
    rows = rd.metric_snapshot_rows(back, "user_id")
    return rows.groupBy("user_id").agg(F.count("ts").alias("n"), F.sum(F.round(F.col("response_time") * 100).cast("bigint")).alias("cents"))


def _s14_sql():
    h1 = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '^[\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+|[\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+$', '', 'g')"
    blk = "regexp_replace(regexp_replace(b, '<[^>]+>', '', 'g'), '^[\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+|[\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+$', '', 'g')"
    return f"""WITH p AS (SELECT page_id, {h1} AS author, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS bs FROM pages),
e AS (SELECT page_id, author, unnest(bs) AS b, unnest(range(0, len(bs))) AS pos FROM p),
c AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, author, {blk} AS text FROM e)
SELECT page_id, pos, md5(author) AS author_md5, md5(text) AS text_md5 FROM c WHERE text <> '' AND author <> ''"""


@register("s14_html_comments", _s14_sql())
def s14_html_comments(spark, sf_dir):
    c = rd.extract_comments(table(spark, sf_dir, "pages"))
    return c.select("page_id", "pos", F.md5("author").alias("author_md5"), F.md5("text").alias("text_md5"))


def _turn_pages(spark, sf_dir):
    """Pages of comments from the conversations: each even turn is a comment, and
    the turn behind it a reply inside its element."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def escaped(c):
        return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name, at = F.concat_ws("_", "conv_id", "turn"), F.col("turn").cast("string")

    def element(link, inner):
        return F.concat(F.lit('<div role="article"><a role="link" tabindex="0" href="/u?a=1&amp;b=2"><span>'), escaped("role"), F.lit('</span></a><p><div dir="auto">'), escaped("text"),
                        F.lit('<br></div><a href="/p?'), link, F.lit('">'), at, F.lit(' h</a><span aria-label="'), (F.col("turn") + 2).cast("string"), F.lit(' reactions">x</span>'), inner, F.lit("</div>"))
    top = t.filter(F.col("turn") % 2 == 0)
    reply = t.filter(F.col("turn") % 2 == 1).select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), element(
        F.concat(F.lit("comment_id="), F.concat_ws("_", "conv_id", F.col("turn") - 1), F.lit("&amp;reply_comment_id="), name), F.lit("")).alias("_reply"))
    both = top.join(reply, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    inner = F.coalesce(F.concat(F.lit('<ul><li style="margin-left:8px">'), F.col("_reply"), F.lit("</ul>")), F.lit(""))
    return both.select(name.alias("page_id"), F.concat(F.lit("<html><body><script>'<div role=\"article\">'</script>"), element(F.concat(F.lit("comment_id="), name), inner), F.lit("</body>")).alias("html"))


_STRIP = "regexp_replace(coalesce({}, ''), '^[\\t\\n\\x0B\\f\\r\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+|[\\t\\n\\x0B\\f\\r\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+$', '', 'g')"


@register("s14_j5_comment_tree", f"""WITH t AS (SELECT conv_id, turn, {_STRIP.format("role")} AS author, {_STRIP.format("text")} AS text FROM conversations),
r AS (SELECT t.*, conv_id || '_' || (turn - turn % 2) AS page_id FROM t WHERE turn % 2 = 0 OR EXISTS (SELECT 1 FROM t AS e WHERE e.conv_id = t.conv_id AND e.turn = t.turn - 1))
SELECT page_id, CAST(turn % 2 AS INTEGER) AS pos, conv_id || '_' || turn AS comment_id, CASE WHEN turn % 2 = 1 THEN page_id END AS parent_id, author, turn || ' h' AS posted,
  md5(text) AS text_md5, turn % 2 = 1 AS is_reply, CAST(turn + 2 AS INTEGER) AS reactions FROM r WHERE text <> '' AND author <> ''""")
def s14_j5_comment_tree(spark, sf_dir):
    c = rd.comment_tree(_turn_pages(spark, sf_dir))
    return c.select("page_id", "pos", "comment_id", "parent_id", "author", "posted", F.md5("text").alias("text_md5"), "is_reply", F.col("reactions.total").alias("reactions"))


@register("k1_k3_write_and_append", f"""WITH d AS ({LABELLED_DOCS}) SELECT doc_id, label, md5(text) AS text_md5, CAST(2 AS BIGINT) AS n FROM d""")
def k1_k3_write_and_append(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir).select("doc_id", "label", "text")
    path = scratch_path(spark, "k1")
    sk.write_dataset(d, path)
    sk.append_labelled(d, path)
    back = spark.read.parquet(path).select("doc_id", "label", F.md5("text").alias("text_md5"))
    return back.groupBy("doc_id", "label", "text_md5").agg(F.count(F.lit(1)).alias("n"))


@register("k2_ingest_sink", """SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source""")
def k2_ingest_sink(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    path = scratch_path(spark, "k2")
    sk.write_ingests(d, path, "2024-01-01T00")
    sk.write_ingest(d.filter(F.lit(False)).drop("source"), path, "empty", "2024-01-01T00")
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("k7_report_metric_rows", """WITH r AS (SELECT event_type = 'error' AS e, value FROM events)
SELECT * FROM (VALUES ('total_requests', (SELECT format('{:,.4f}', CAST(count(*) AS DOUBLE)) FROM r)),
  ('total_errors', (SELECT format('{:,.4f}', CAST(sum(CAST(e AS INTEGER)) AS DOUBLE)) FROM r))) t(metric, value)""")
def k7_report_metric_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.agg(F.count(F.lit(1)).alias("total_requests"), F.sum((F.col("event_type") == "error").cast("int")).alias("total_errors"))
    return sk.metric_rows(m)


@register("k8_export_log_lines", """SELECT CAST(event_id AS VARCHAR) || ' - ' || event_type AS line FROM events WHERE event_type = 'error'""")
def k8_export_log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    path = scratch_path(spark, "k8")
    sk.write_lines(e.select(F.concat_ws(" - ", F.col("event_id").cast("string"), "event_type").alias("line")), "line", path)
    return spark.read.text(path).select(F.col("value").alias("line"))
