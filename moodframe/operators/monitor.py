"""Request and model monitoring over event tables (A10-A12, A19-A23,
W1-W3, W5-W7, W9-W11, M24, P13, P14, Y1, Y2).

Event table contract: ``ts`` (TIMESTAMP_NTZ), a client key, ``latency``
and ``is_error``. "Now" is anchored at ``max(ts)`` so results are
repeatable. Per-client windows are partitioned by client; ordered scans that
could fall on one hot key (segments, top-k) are done in two levels
(per time bucket, then over a small bucket table).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import lexicon as lx

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_seconds(c: str) -> Column:
    """Seconds since 1970 of a TIMESTAMP_NTZ, independent of session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {c})") / F.lit(1_000_000.0)


def request_events(events: DataFrame) -> DataFrame:
    """Map the generic event table onto requests: client, latency, error."""
    return events.select("event_id", "ts", F.col("user_id").alias("client"), "event_type",
                         F.col("value").alias("latency"), (F.col("event_type") == "error").alias("is_error"), "props")


def totals(req: DataFrame) -> DataFrame:
    """A10 + A22: totals, error total, error rate, mean latency, success rate."""
    return req.agg(F.count(F.lit(1)).alias("total_requests"),
                   F.sum(F.col("is_error").cast("long")).alias("total_errors"),
                   F.avg("latency").alias("avg_response_time")).select(
        "total_requests", "total_errors", "avg_response_time",
        (F.col("total_errors") / F.col("total_requests")).alias("error_rate"),
        (1 - F.col("total_errors") / F.col("total_requests")).alias("success_rate"))


def last_n(req: DataFrame, n: int = 100) -> DataFrame:
    """The newest n events (a TakeOrdered, no global window)."""
    return req.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def rolling_last_n(req: DataFrame, n: int = 100, key: str = "client", value: str = "latency",
                   block: int = 10_000) -> DataFrame:
    """W1 per-event form: sum, count and mean of ``value`` over the client's
    last n events (ts, event_id order).

    Each client's rows are numbered with ``two_level_prefix`` (no
    client-wide window), cut into blocks of ``block`` rows, and every row is
    copied as a halo into the later blocks that its next n - 1 rows reach; the
    ROWS window then runs per (client, block)."""
    idx = two_level_prefix(req, key, "ts", "event_id", ["event_id"], lambda p, c: F.lit(True), "_idx", 0)
    idx = idx.withColumn("_blk", ((F.col("_idx") - 1) / block).cast("long"))
    reach = ((F.col("_idx") + (n - 2)) / block).cast("long")
    later = F.when(reach > F.col("_blk"), F.sequence(F.col("_blk") + 1, reach)).otherwise(F.array().cast("array<bigint>"))
    halo = idx.withColumn("_blk", F.explode(later))
    both = idx.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_blk").orderBy("_idx").rowsBetween(-(n - 1), 0)
    out = both.select("*", F.sum(value).over(w).alias("rolling_sum"), F.count(F.lit(1)).over(w).alias("rolling_n"))
    out = out.withColumn("rolling_avg", F.col("rolling_sum") / F.col("rolling_n"))
    return out.filter("_own").drop("_idx", "_blk", "_own")


def trailing_rate(req: DataFrame, seconds: int, key: str = "client", id_col: str = "event_id", per_bucket: int = 4) -> DataFrame:
    """Per event, the client's events in the trailing ``seconds`` / seconds.

    Exact without a client-wide window: time is cut into buckets of
    ``per_bucket`` windows; the rows of a bucket's last ``seconds`` are copied
    into the next one as a halo, so each (client, bucket) partition holds all
    that its own rows' windows can reach; only the bucket's own rows are kept. A
    hot client is spread over its buckets."""
    t, width = epoch_seconds("ts"), per_bucket * seconds
    base = req.withColumn("_t", t).withColumn("_b", F.floor(t / width).cast("long"))
    edge = base.where(F.col("_t") >= (F.col("_b") + 1) * width - seconds)
    halo = base.withColumn("_own", F.lit(True)).unionByName(
        edge.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-seconds, 0)
    out = halo.withColumn("rate", F.count(F.lit(1)).over(w) / F.lit(float(seconds)))
    return out.filter("_own").drop("_t", "_b", "_own")


def anchored_since(req: DataFrame, seconds: float) -> DataFrame:
    """Y2 + W3: rows with ts >= max(ts) - seconds. The anchor is a one-row
    aggregate (served from Parquet footers when aggregate pushdown applies);
    the cutoff then filters as a literal, so it reaches the scan as a pushed
    filter and prunes row groups."""
    import datetime as _dt
    mx = req.agg(F.max("ts")).first()[0]
    if mx is None:
        return req.limit(0)
    cut = mx - _dt.timedelta(seconds=seconds)
    return req.filter(F.col("ts") >= F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz"))


def windowed(req: DataFrame, period: str) -> DataFrame:
    """A20/ST3: tumbling-window request count, errors, mean latency."""
    return req.groupBy(F.window("ts", period).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("is_error").cast("long")).alias("errors"),
        F.avg("latency").alias("avg_latency")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests", "errors", "avg_latency")


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int, buckets: int = 64,
                    bucket_key: str | None = None) -> DataFrame:
    """Top-k rows per group in two levels: first inside (group, hash bucket)
    partitions, then over the <= k * buckets survivors per group. No window
    partition ever holds a whole hot group."""
    bk = F.abs(F.xxhash64(F.col(bucket_key or df.columns[0]))) % buckets
    w1 = Window.partitionBy(group, "_bk").orderBy(*order)
    cand = df.withColumn("_bk", bk).withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(group).orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).drop("_bk", "_r1")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which a null key meets a null key, keys kept once."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, cond).drop(*[f"_r_{k}" for k in keys])


def bucket_width(df: DataFrame, key: str, ts: str, most: int = 1_000_000) -> float:
    """Seconds of a time bucket: a day, or as much less as keeps the fullest
    (key, day) at about ``most`` rows a bucket."""
    days = df.groupBy(key, F.floor(epoch_seconds(ts) / 86400).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    fullest = days.agg(F.max("_n")).first()[0] or 0
    return 86400.0 if fullest <= most else max(0.001, 86400.0 * most / fullest)


def two_level_prefix(df: DataFrame, key: str, ts: str, tiebreak: str, carry: list[str], flag_fn,
                     out: str, start: int = 0, bucket_seconds: float | None = None) -> DataFrame:
    """Running count per key of rows where ``flag_fn(prev, cur)`` holds,
    ``prev`` being the key's previous row (by ts, tiebreak) — computed
    without a key-wide window:

    1. rows are bucketed by (key, time bucket); ``lag`` inside a bucket gives
       the previous row, and for a bucket's first row the last row of the
       key's previous non-empty bucket comes from a small (key, bucket)
       table;
    2. flags are summed inside the bucket, and each bucket's offset is a
       cumulative sum over the small table.
    ``carry`` are the columns ``flag_fn`` reads from ``prev``/``cur``. Without
    ``bucket_seconds`` the width follows from the fullest day of a key."""
    bucket_seconds = bucket_seconds or bucket_width(df, key, ts)
    d = df.withColumn("_bk", F.floor(epoch_seconds(ts) / bucket_seconds).cast("long"))
    wi = Window.partitionBy(key, "_bk").orderBy(ts, tiebreak)
    lasts = d.groupBy(key, "_bk").agg(F.max_by(F.struct(*carry), F.struct(ts, tiebreak)).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_bk")
    lasts = lasts.select(key, "_bk", F.lag("_last").over(wb).alias("_prev_last"))
    d = join_null_safe(d, lasts, [key, "_bk"])
    prev = {c: F.coalesce(F.lag(c).over(wi), F.when(F.row_number().over(wi) == 1, F.col("_prev_last").getField(c))) for c in carry}
    cur = {c: F.col(c) for c in carry}
    d = d.withColumn("_flag", flag_fn(prev, cur).cast("long"))
    d = d.withColumn("_local", F.sum("_flag").over(wi.rowsBetween(Window.unboundedPreceding, 0)))
    tot = d.groupBy(key, "_bk").agg(F.sum("_flag").alias("_n"))
    tot = tot.select(key, "_bk", F.coalesce(F.sum("_n").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    d = join_null_safe(d, tot, [key, "_bk"])
    return d.withColumn(out, F.col("_off") + F.col("_local") + F.lit(start)).drop("_bk", "_prev_last", "_flag", "_local", "_off")


def status_segments(df: DataFrame, key: str, ts: str, tiebreak: str, available: str,
                    bucket_seconds: float | None = None) -> DataFrame:
    """A new segment starts at every available -> unavailable change."""
    flag = lambda p, c: F.coalesce(p[available], F.lit(False)) & ~c[available]
    return two_level_prefix(df, key, ts, tiebreak, [available], flag, "segment", 0, bucket_seconds)


def gap_sessions(df: DataFrame, key: str, ts: str, tiebreak: str, gap_seconds: int,
                 bucket_seconds: float | None = None) -> DataFrame:
    """Session number per key (from 1): a gap >= ``gap_seconds`` since the
    previous event starts a new session (unlike session_window, which merges
    an event exactly ``gap`` later)."""
    d = df.withColumn("_t", epoch_seconds(ts))
    flag = lambda p, c: p["_t"].isNull() | (c["_t"] - p["_t"] >= gap_seconds)
    return two_level_prefix(d, key, ts, tiebreak, ["_t"], flag, "session", 0, bucket_seconds).drop("_t")


def admission_by_session(req: DataFrame, calls: int, period_seconds: int, key: str = "client") -> DataFrame:
    """W10 batch form: accepted while the running count in the idle-gap
    session is <= calls. Exact whenever no session overflows; the exact rule
    (rejects do not extend a session) is ``admission_exact``."""
    s = gap_sessions(req, key, "ts", "event_id", period_seconds)
    w = Window.partitionBy(key, "session").orderBy("ts", "event_id")
    return s.withColumn("accepted", F.row_number().over(w) <= calls)


def admission_exact(req: DataFrame, calls: int, period_seconds: int, key: str = "client",
                    bucket_seconds: float | None = None) -> DataFrame:
    """W10/ST5 exact rule: a request is accepted when the client has no live
    history or fewer than ``calls`` accepted in it; history is forgotten once
    the last *accepted* request is older than ``period_seconds``; rejected
    requests do not extend it.

    History always resets at a gap >= period between consecutive events, so a
    session of at most ``calls`` events is accepted whole. In a longer one, a run
    that starts at event i accepts i .. i + calls - 1, and the next run starts at
    the first event with t >= t(i + calls - 1) + period: a pointer from every
    event to another, found by prefix counts in time buckets. The starts that are
    reached from a session's first event are marked by pointer doubling: the
    round k joins what is reached in 2^k steps with pointers of 2^k steps. Every
    step is a join or a window over (client, time bucket), however long a burst
    or hot a client is."""
    from ..session import materialize
    rows = req.select(key, "event_id", "ts")
    if calls < 1:
        return rows.select(key, "event_id", F.lit(False).alias("accepted"))
    width = bucket_seconds or bucket_width(rows, key, "ts")
    s = materialize(gap_sessions(rows, key, "ts", "event_id", period_seconds, width), "admission-sessions")
    sizes = s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("_size"))
    most = sizes.agg(F.max("_size")).first()[0] or 0
    short = join_null_safe(s, sizes.filter(F.col("_size") <= calls), [key, "session"]).select(key, "event_id", F.lit(True).alias("accepted"))
    if most <= calls:
        return short
    # events of long sessions, numbered by client: a session's numbers are consecutive
    o = join_null_safe(s, sizes.filter(F.col("_size") > calls), [key, "session"])
    o = materialize(two_level_prefix(o, key, "ts", "event_id", ["event_id"], lambda p, c: F.lit(True), "_i", 0, width), "admission-long")
    spans = o.groupBy(key, "session").agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    full = o.select(key, (F.col("_i") - (calls - 1)).alias("_i"), F.col("session"), F.expr(f"timestampadd(MICROSECOND, {int(period_seconds * 1_000_000)}, ts)").alias("ts"))
    runs = join_null_safe(full, spans, [key, "session"]).filter(F.col("_i") >= F.col("_first"))
    # a pointer is the number of events before the end of the period, plus 1
    asked = runs.select(key, "ts", F.lit(0).alias("_event"), "_i", "_last").unionByName(o.select(key, "ts", F.lit(1).alias("_event"), "_i", F.lit(None).cast("long").alias("_last")))
    asked = two_level_prefix(asked, key, "ts", "_event", ["_event"], lambda p, c: c["_event"] == 1, "_to", 1, width)
    to = asked.filter((F.col("_event") == 0) & (F.col("_to") <= F.col("_last"))).select(key, "_i", "_to")
    to, reached = materialize(to, "admission-pointers"), spans.select(key, F.col("_first").alias("_i"))
    for _ in range(math.ceil(math.log2(-(-most // calls))) if most > calls else 0):
        reached = materialize(reached.unionByName(join_null_safe(reached, to, [key, "_i"]).select(key, F.col("_to").alias("_i"))), "admission-reached")
        onward = to.select(key, F.col("_i").alias("_to"), F.col("_to").alias("_further"))
        to = materialize(join_null_safe(to, onward, [key, "_to"]).select(key, "_i", F.col("_further").alias("_to")), "admission-pointers")
    taken = reached.select(F.col(key).alias("_k"), F.explode(F.sequence("_i", F.col("_i") + (calls - 1))).alias("_at")).distinct()    # a run that a session's end cuts short reaches into the next
    long = o.join(taken, o[key].eqNullSafe(taken["_k"]) & (o["_i"] == taken["_at"]), "left")
    return short.unionByName(long.select(key, "event_id", F.col("_at").isNotNull().alias("accepted")))


def alerts(metrics: DataFrame) -> DataFrame:
    """(name, value) rows checked against the threshold table (both
    threshold sets); 'min' kinds alert below, 'max' kinds above."""
    th = metrics.sparkSession.createDataFrame(lx.ALERT_THRESHOLDS, "metric STRING, threshold DOUBLE, kind STRING")
    j = metrics.join(F.broadcast(th), "metric")
    hit = F.when(F.col("kind") == "min", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return j.withColumn("alert", hit)


# ---- log lines (S12, P13, P14, W7, Y1) --------------------------------------------

LOG_RE = r"^(\S+ \S+) - (\S+) - (\S+) - (.*)$"


def parse_log_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Split ``asctime - name - LEVEL - message`` lines into columns; a line
    without that shape keeps null fields and its raw message."""
    v = F.col(col)
    ok = v.rlike(LOG_RE)
    return lines.select(
        "*",
        F.when(ok, F.regexp_extract(v, LOG_RE, 1)).alias("time_str"),
        F.when(ok, F.regexp_extract(v, LOG_RE, 2)).alias("logger"),
        F.when(ok, F.regexp_extract(v, LOG_RE, 3)).alias("level"),
        F.when(ok, F.regexp_extract(v, LOG_RE, 4)).otherwise(v).alias("message"),
    ).withColumn("log_ts", F.try_to_timestamp(F.col("time_str"), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).cast("timestamp_ntz"))


def filter_logs(logs: DataFrame, level=None, since=None, kind=None, path=None, status=None, line: str = "value") -> DataFrame:
    """AND-ed filters over parsed lines; kind, path and status look for
    their text anywhere in the whole line, an unparseable time passes the
    ``since`` test (Y1)."""
    cond = F.lit(True)
    if level:
        cond = cond & (F.upper(F.col("level")) == level.upper())
    if since is not None:
        cond = cond & F.coalesce(F.col("log_ts") >= F.lit(since).cast("timestamp_ntz"), F.lit(True))
    marks = {"request": "Request:", "response": "Response:", "init": "API Server"}      # FIXED: what a line of a kind holds
    whole = F.col(line)
    if kind:
        cond = cond & whole.contains(marks[kind])
    if path:
        cond = cond & whole.contains(path)
    if status is not None:
        cond = cond & whole.contains(f"Status: {status}")
    return logs.filter(cond)
