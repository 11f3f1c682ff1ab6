"""Queries for request metrics, windows, retention, checkpoints, segments,
admission control, alerts and log lines, all over ``events``."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import monitor as mo
from ..session import scratch_path
from ..sources.tables import table
from .registry import register
from .sqlparts import r6, round_doubles

REQ_SQL = ("SELECT event_id, ts, user_id AS client, event_type, value AS latency, "
           "event_type = 'error' AS is_error, props FROM events")


def _req(spark, sf_dir):
    return mo.request_events(table(spark, sf_dir, "events"))


@register("a10_a22_request_totals", f"""WITH r AS ({REQ_SQL})
SELECT CAST(count(*) AS BIGINT) AS total_requests, CAST(sum(CAST(is_error AS BIGINT)) AS BIGINT) AS total_errors,
  {r6('avg(latency)')} AS avg_response_time, {r6('sum(CAST(is_error AS BIGINT)) / count(*)')} AS error_rate,
  {r6('1 - sum(CAST(is_error AS BIGINT)) / count(*)')} AS success_rate FROM r""")
def a10_request_totals(spark, sf_dir):
    return round_doubles(mo.totals(_req(spark, sf_dir)))


@register("w1_last_n_buffer", f"""WITH r AS ({REQ_SQL}), l AS (SELECT * FROM r ORDER BY ts DESC, event_id DESC LIMIT 100)
SELECT CAST(count(*) AS BIGINT) AS buffered, {r6('avg(latency)')} AS avg_latency,
  CAST(sum(CAST(is_error AS BIGINT)) AS BIGINT) AS errors FROM l""")
def w1_last_n_buffer(spark, sf_dir):
    l = mo.last_n(_req(spark, sf_dir), 100)
    return round_doubles(l.agg(F.count(F.lit(1)).alias("buffered"), F.avg("latency").alias("avg_latency"),
                               F.sum(F.col("is_error").cast("long")).alias("errors")))


@register("w1_rolling_last_n_per_client", f"""WITH r AS ({REQ_SQL})
SELECT event_id, client,
  CAST(sum(CAST(round(latency * 100) AS BIGINT)) OVER (PARTITION BY client ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_sum_cents,
  CAST(count(*) OVER (PARTITION BY client ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_n FROM r""")
def w1_rolling_last_n_per_client(spark, sf_dir):
    """Rolling sums over the client's last 100 events, in exact integer
    cents (the mean is sum / n)."""
    r = _req(spark, sf_dir).withColumn("cents", F.round(F.col("latency") * 100).cast("bigint"))
    out = mo.rolling_last_n(r, 100, "client", "cents", block=500)
    return out.select("event_id", "client", F.col("rolling_sum").alias("rolling_sum_cents"), "rolling_n")


@register("w2_trailing_rate_per_client", f"""WITH r AS ({REQ_SQL})
SELECT event_id, client, {r6('count(*) OVER (PARTITION BY client ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) / 86400.0')} AS rate FROM r""")
def w2_trailing_rate_per_client(spark, sf_dir):
    return round_doubles(mo.trailing_rate(_req(spark, sf_dir), 86400).select("event_id", "client", "rate"))


@register("a19_uptime_throughput", f"""WITH r AS ({REQ_SQL})
SELECT {r6('epoch(max(ts)) - epoch(min(ts))')} AS uptime_seconds,
  {r6("count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 3600 SECOND) / 3600.0")} AS requests_per_second FROM r""")
def a19_uptime_throughput(spark, sf_dir):
    r = _req(spark, sf_dir)
    up = r.agg((F.max(mo.epoch_seconds("ts")) - F.min(mo.epoch_seconds("ts"))).alias("uptime_seconds"))
    last = mo.anchored_since(r, 3600).agg((F.count(F.lit(1)) / F.lit(3600.0)).alias("requests_per_second"))
    return round_doubles(up.join(last))


def _a20(range_s, period, period_sql):
    sql = f"""WITH r AS ({REQ_SQL}), f AS (SELECT * FROM r WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL {range_s} SECOND)
SELECT strftime(time_bucket(INTERVAL '{period_sql}', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS requests,
  CAST(sum(CAST(is_error AS BIGINT)) AS BIGINT) AS errors, {r6('avg(latency)')} AS avg_latency FROM f GROUP BY 1"""

    def fn(spark, sf_dir):
        return round_doubles(mo.windowed(mo.anchored_since(_req(spark, sf_dir), range_s), period))
    return sql, fn


for _name, _rs, _p, _ps in [("a20_metrics_24h_by_hour", 86400, "1 hour", "1 hour"),
                            ("a20_metrics_7d_by_day", 7 * 86400, "1 day", "1 day"),
                            ("st3_metrics_6h_by_5min", 6 * 3600, "5 minutes", "5 minutes")]:
    _s, _f = _a20(_rs, _p, _ps)
    register(_name, _s)(_f)


@register("w3_retention_7d", f"""WITH r AS ({REQ_SQL}), f AS (SELECT * FROM r WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 604800 SECOND)
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(is_error AS BIGINT)) AS BIGINT) AS errors FROM f GROUP BY event_type""")
def w3_retention_7d(spark, sf_dir):
    f = mo.anchored_since(_req(spark, sf_dir), 7 * 86400)
    return f.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_error").cast("long")).alias("errors"))


CKPT_SQL = """SELECT event_id, ts, 'ckpt/' || event_id AS path,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'vi' ELSE 'en' END AS language,
  value AS best_score FROM events WHERE event_type = 'signup'"""


def _ckpts(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "ts", F.concat(F.lit("ckpt/"), F.col("event_id").cast("string")).alias("path"),
                    F.when(k % 2 == 0, "vi").otherwise("en").alias("language"), F.col("value").alias("best_score"))


@register("w5_keep_newest_checkpoints", f"""WITH c AS ({CKPT_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ts DESC, event_id DESC) AS rank FROM c)
SELECT language, path, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {lx.MAX_CHECKPOINTS}""")
def w5_keep_newest_checkpoints(spark, sf_dir):
    c = _ckpts(spark, sf_dir)
    top = mo.top_k_per_group(c, "language", [F.col("ts").desc(), F.col("event_id").desc()], lx.MAX_CHECKPOINTS, bucket_key="event_id")
    return top.select("language", "path", F.col("rank").cast("int"))


@register("w6_latest_checkpoint", f"""WITH c AS ({CKPT_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ts DESC, event_id DESC) AS rn FROM c)
SELECT language, path AS latest_path, CAST((SELECT count(*) FROM c c2 WHERE c2.language = r.language) AS BIGINT) AS n_checkpoints FROM r WHERE rn = 1""")
def w6_latest_checkpoint(spark, sf_dir):
    c = _ckpts(spark, sf_dir)
    return c.groupBy("language").agg(F.max_by("path", F.struct("ts", "event_id")).alias("latest_path"),
                                     F.count(F.lit(1)).alias("n_checkpoints"))


@register("a11_model_performance_by_language", f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
  WHERE event_type IN ('signup', 'purchase')),
m AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'vi' ELSE 'en' END AS language FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ts DESC, event_id DESC) AS rn FROM m)
SELECT language, {r6("avg(value) FILTER (WHERE event_type = 'signup')")} AS avg_loading_time,
  {r6("coalesce(avg(value) FILTER (WHERE event_type = 'purchase'), 0.0)")} AS avg_inference_time,
  {r6('max(CASE WHEN rn = 1 THEN k / 100.0 END)')} AS latest_accuracy FROM r GROUP BY language""")
def a11_model_performance_by_language(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase"))
    k = F.get_json_object("props", "$.k").cast("int")
    m = e.select("*", k.alias("k")).withColumn("language", F.when(F.col("k") % 2 == 0, "vi").otherwise("en"))
    out = m.groupBy("language").agg(
        F.avg(F.when(F.col("event_type") == "signup", F.col("value"))).alias("avg_loading_time"),
        F.coalesce(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("avg_inference_time"),
        F.max_by(F.col("k") / 100.0, F.struct("ts", "event_id")).alias("latest_accuracy"))
    return round_doubles(out)


@register("w9_status_segments", f"""WITH r AS (SELECT event_id, ts, user_id % 7 AS source, event_type <> 'error' AS available FROM events),
l AS (SELECT *, lag(available) OVER (PARTITION BY source ORDER BY ts, event_id) AS prev FROM r),
c AS (SELECT *, sum(CASE WHEN coalesce(prev, false) AND NOT available THEN 1 ELSE 0 END)
        OVER (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM l)
SELECT source, CAST(segment AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS analyzed,
  CAST(sum(CAST(available AS BIGINT)) AS BIGINT) AS successful, min(event_id) AS first_event FROM c GROUP BY source, segment""")
def w9_status_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 7).alias("source"),
                                              (F.col("event_type") != "error").alias("available"))
    s = mo.status_segments(e, "source", "ts", "event_id", "available")
    return s.groupBy("source", F.col("segment").cast("bigint").alias("segment")).agg(
        F.count(F.lit(1)).alias("analyzed"), F.sum(F.col("available").cast("long")).alias("successful"),
        F.min("event_id").alias("first_event"))


ADMIT_CALLS, ADMIT_PERIOD = 2, 3600


@register("w10_admission_sessions", f"""WITH r AS ({REQ_SQL}),
l AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY client ORDER BY ts, event_id) AS gap FROM r),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {ADMIT_PERIOD} THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM l)
SELECT event_id, client, row_number() OVER (PARTITION BY client, session ORDER BY ts, event_id) <= {ADMIT_CALLS} AS accepted FROM s""")
def w10_admission_sessions(spark, sf_dir):
    """An approximation of w10_admission_exact: a session ends at an idle gap."""
    return mo.admission_by_session(_req(spark, sf_dir), ADMIT_CALLS, ADMIT_PERIOD).select("event_id", "client", "accepted")


# The rule itself, client by client and request by request.
ADMIT_SQL = f"""WITH RECURSIVE r AS (SELECT user_id AS client, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT client, event_id, rn, 1 AS n, t AS last, true AS accepted FROM r WHERE rn = 1
  UNION ALL SELECT r.client, r.event_id, r.rn, CASE WHEN r.t - s.last >= {ADMIT_PERIOD} THEN 1 WHEN s.n < {ADMIT_CALLS} THEN s.n + 1 ELSE s.n END,
    CASE WHEN r.t - s.last >= {ADMIT_PERIOD} OR s.n < {ADMIT_CALLS} THEN r.t ELSE s.last END, r.t - s.last >= {ADMIT_PERIOD} OR s.n < {ADMIT_CALLS}
  FROM s JOIN r ON r.client = s.client AND r.rn = s.rn + 1)
SELECT event_id, client, accepted FROM s"""


@register("w10_admission_exact", ADMIT_SQL)
def w10_admission_exact(spark, sf_dir):
    """The exact rule (rejects do not extend a session)."""
    return mo.admission_exact(_req(spark, sf_dir), ADMIT_CALLS, ADMIT_PERIOD).select("event_id", "client", "accepted")


@register("w11_chart_ring", f"""WITH r AS ({REQ_SQL}),
w AS (SELECT time_bucket(INTERVAL '1 second', ts) AS ws, count(*) AS n FROM r GROUP BY 1),
l AS (SELECT * FROM w ORDER BY ws DESC LIMIT 300)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(n AS BIGINT) AS requests FROM l""")
def w11_chart_ring(spark, sf_dir):
    w = mo.windowed(_req(spark, sf_dir), "1 second")
    return w.orderBy(F.col("window_start").desc()).limit(300).select("window_start", "requests")


@register("m24_alerts", f"""WITH r AS ({REQ_SQL}),
m AS (SELECT 'error_rate' AS metric, sum(CAST(is_error AS BIGINT)) / count(*) AS value FROM r
      UNION ALL SELECT 'response_time', avg(latency) FROM r),
t AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b}::DOUBLE, '{c}')" for a, b, c in lx.ALERT_THRESHOLDS)}) t(metric, threshold, kind))
SELECT m.metric, {r6('m.value')} AS value, t.threshold, CASE WHEN t.kind = 'min' THEN m.value < t.threshold ELSE m.value > t.threshold END AS alert
FROM m JOIN t ON m.metric = t.metric""")
def m24_alerts(spark, sf_dir):
    r = _req(spark, sf_dir)
    m = r.agg((F.sum(F.col("is_error").cast("long")) / F.count(F.lit(1))).alias("error_rate"),
              F.avg("latency").alias("response_time"))
    long = m.select(F.explode(F.array(F.struct(F.lit("error_rate").alias("metric"), F.col("error_rate").alias("value")),
                                      F.struct(F.lit("response_time").alias("metric"), F.col("response_time").alias("value")))).alias("x"))
    return round_doubles(mo.alerts(long.select("x.*")).select("metric", "value", "threshold", "alert"))


# ---- log lines ----------------------------------------------------------------------

def _log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    msg = F.when(F.col("event_id") % 17 == 5, F.lit("API Server starting")).when(F.col("event_id") % 17 == 6, F.lit("retry of Request: GET /initiate")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("Request: GET /"), F.col("event_type"))).otherwise(
        F.concat(F.lit("Response: /"), F.col("event_type"), F.lit(" Status: "),
                 F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")),
                 F.lit(" Time: "), F.round(F.col("value") * 100).cast("bigint").cast("string")))
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    line = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("xx yy - api - "), level, F.lit(" - "), msg)).otherwise(
        F.concat(stamp, F.lit(" - api - "), level, F.lit(" - "), msg))
    return e.select("event_id", line.alias("value"))


LOG_SQL = """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'xx yy - api - ' || lvl || ' - ' || msg
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - api - ' || lvl || ' - ' || msg END AS value FROM (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS lvl,
    CASE WHEN event_id % 17 = 5 THEN 'API Server starting' WHEN event_id % 17 = 6 THEN 'retry of Request: GET /initiate' WHEN event_id % 2 = 0 THEN 'Request: GET /' || event_type
    ELSE 'Response: /' || event_type || ' Status: ' || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END
         || ' Time: ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS msg FROM events)"""

PARSED_SQL = f"""SELECT event_id, value,
  CASE WHEN regexp_matches(value, '{mo.LOG_RE}') THEN regexp_extract(value, '{mo.LOG_RE}', 1) END AS time_str,
  CASE WHEN regexp_matches(value, '{mo.LOG_RE}') THEN regexp_extract(value, '{mo.LOG_RE}', 3) END AS level,
  CASE WHEN regexp_matches(value, '{mo.LOG_RE}') THEN regexp_extract(value, '{mo.LOG_RE}', 4) ELSE value END AS message,
  try_strptime(CASE WHEN regexp_matches(value, '{mo.LOG_RE}') THEN regexp_extract(value, '{mo.LOG_RE}', 1) END, '%Y-%m-%d %H:%M:%S,%g') AS log_ts
FROM ({LOG_SQL})"""


@register("s12_log_lines_source", """WITH l AS (""" + LOG_SQL + """)
SELECT CASE WHEN value LIKE '%ERROR%' THEN 'ERROR' ELSE 'INFO' END AS level, md5(value) AS line_md5 FROM l""")
def s12_log_lines_source(spark, sf_dir):
    """Lines are written as a text file and read back with spark.read.text."""
    path = scratch_path(spark, "logs")
    _log_lines(spark, sf_dir).select("value").write.mode("overwrite").text(path)
    lines = spark.read.text(path)
    return lines.select(F.when(F.col("value").contains("ERROR"), "ERROR").otherwise("INFO").alias("level"), F.md5("value").alias("line_md5"))


@register("p13_log_filters", f"""WITH p AS ({PARSED_SQL})
SELECT event_id, 'response' AS kind FROM p WHERE upper(level) = 'ERROR' AND coalesce(log_ts >= TIMESTAMP '2024-01-10 00:00:00', true)
  AND value LIKE '%Response:%' AND value LIKE '%/error%' AND value LIKE '%Status: 500%'
UNION ALL SELECT event_id, 'init' FROM p WHERE event_id % 17 = 5
UNION ALL SELECT event_id, 'request' FROM p WHERE event_id % 17 = 6 AND upper(level) = 'INFO'""")
def p13_log_filters(spark, sf_dir):
    p = mo.parse_log_lines(_log_lines(spark, sf_dir))
    f = mo.filter_logs(p, level="ERROR", since="2024-01-10 00:00:00", kind="response", path="/error", status=500)
    i = mo.filter_logs(p, kind="init", path=" - api - ")
    r = mo.filter_logs(p, level="info", kind="request", path="/initiate")
    return (f.select("event_id", F.lit("response").alias("kind")).unionByName(i.select("event_id", F.lit("init").alias("kind")))
            .unionByName(r.select("event_id", F.lit("request").alias("kind"))))


@register("p14_log_search", f"""WITH p AS ({PARSED_SQL})
SELECT event_id FROM p WHERE contains(message, 'purchase') AND log_ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00'""")
def p14_log_search(spark, sf_dir):
    p = mo.parse_log_lines(_log_lines(spark, sf_dir))
    return p.filter(F.col("message").contains("purchase") &
                    F.col("log_ts").between(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"),
                                            F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))).select("event_id")


@register("w7_last_n_log_lines", f"""WITH p AS ({PARSED_SQL}), f AS (SELECT * FROM p WHERE upper(level) = 'ERROR'),
l AS (SELECT * FROM f ORDER BY event_id DESC LIMIT 50)
SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS position FROM l""")
def w7_last_n_log_lines(spark, sf_dir):
    from pyspark.sql import Window
    p = mo.parse_log_lines(_log_lines(spark, sf_dir))
    f = mo.filter_logs(p, level="ERROR")
    last = f.orderBy(F.col("event_id").desc()).limit(50)
    # The window runs over the 50 kept lines only.
    return last.select("event_id", F.row_number().over(Window.orderBy("event_id")).cast("int").alias("position"))


@register("y1_timestamp_parse_keep_unparseable", f"""WITH p AS ({PARSED_SQL})
SELECT CAST(count(*) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE log_ts IS NULL) AS BIGINT) AS unparsed FROM p
WHERE coalesce(log_ts >= TIMESTAMP '2024-01-20 00:00:00', true)""")
def y1_timestamp_parse(spark, sf_dir):
    p = mo.parse_log_lines(_log_lines(spark, sf_dir))
    f = mo.filter_logs(p, since="2024-01-20 00:00:00")
    return f.agg(F.count(F.lit(1)).alias("kept"), F.count(F.when(F.col("log_ts").isNull(), 1)).alias("unparsed"))
