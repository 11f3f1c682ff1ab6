"""Admission control, status segments, streams vs batch."""
import datetime as dt

from pyspark.sql import functions as F

from moodframe.operators import monitor as mo
from moodframe.streaming import streams as ss

T0 = dt.datetime(2024, 1, 1)


def brute_admission(rows, calls, period):
    state, out = {}, {}
    for c, eid, t in sorted(rows, key=lambda r: (r[2], r[1])):
        n, last = state.get(c, (0, None))
        ts = (t - T0).total_seconds()
        if last is not None and ts - last >= period:
            n, last = 0, None
        if n < calls:
            n, last = n + 1, ts
            out[eid] = True
        else:
            out[eid] = False
        state[c] = (n, last)
    return out


def _admission_rows():
    secs = [0, 1, 2, 30, 61, 62, 121, 200, 260, 320, 321, 1000]
    rows = [(1, i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    rows += [(2, 100 + i, T0 + dt.timedelta(seconds=60 * i)) for i in range(5)]   # gaps of exactly 60 s
    return rows


def test_admission_exact_matches_bruteforce(spark):
    rows = _admission_rows()
    df = spark.createDataFrame(rows, "client LONG, event_id LONG, ts TIMESTAMP_NTZ")
    got = {r.event_id: r.accepted for r in mo.admission_exact(df, 2, 60).collect()}
    assert got == brute_admission(rows, 2, 60)
    # a reject (event 2 at t=2) must not extend the session: event 4 at t=61 is accepted
    assert got[4] is True and got[2] is False


def test_admission_of_hot_clients(spark):
    import random
    r = random.Random(7)
    rows, t = [], 0
    for i in range(3000):                   # one client's unbroken burst, with equal times
        t += r.choice([0, 0, 1, 1, 2, 5]) if i % 1000 else 100
        rows.append((1, i, T0 + dt.timedelta(seconds=t)))
    rows += [(c, 10_000 + 100 * c + i, T0 + dt.timedelta(seconds=r.randint(0, 400))) for c in range(2, 8) for i in range(40)]
    rows += [(None, 20_000 + i, T0 + dt.timedelta(seconds=7 * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "client LONG, event_id LONG, ts TIMESTAMP_NTZ").repartition(6)
    for calls, period, bucket in ((2, 60, None), (7, 10, 50.0), (1, 3, 13.0), (5000, 60, None), (0, 60, None)):
        got = mo.admission_exact(df, calls, period, bucket_seconds=bucket).collect()
        assert len(got) == len(rows) and {x.event_id: x.accepted for x in got} == brute_admission(rows, calls, period)
    assert mo.admission_exact(df.limit(0), 2, 60).count() == 0


def test_admission_stream_matches_batch(spark):
    rows = _admission_rows()
    df = spark.createDataFrame(rows, "client LONG, event_id LONG, ts TIMESTAMP_NTZ")
    path = ss.land_files(df, "ts", 4, "test-adm")
    s = ss.file_stream(spark, path, df.schema)
    out = ss.run_available(ss.admission_stream(s, 2, 60), "test-adm")
    got = {r.event_id: r.accepted for r in ss.read_sink(spark, out, "client long, event_id long, accepted boolean").collect()}
    assert got == brute_admission(rows, 2, 60)


def test_status_segments_bruteforce(spark):
    seq = [True, True, False, False, True, False, True, True, False]
    rows = [(0, i, T0 + dt.timedelta(days=i // 3), a) for i, a in enumerate(seq)]
    df = spark.createDataFrame(rows, "source LONG, event_id LONG, ts TIMESTAMP_NTZ, available BOOLEAN")
    got = [r.segment for r in mo.status_segments(df, "source", "ts", "event_id", "available").orderBy("event_id").collect()]
    seg, prev, ref = 0, None, []
    for a in seq:
        if prev is True and not a:
            seg += 1
        ref.append(seg)
        prev = a
    assert got == ref


def test_rolling_last_n_halo_bruteforce(spark):
    rows = [(c, c * 1000 + i, T0 + dt.timedelta(hours=i * 7 + c), float((i * 37 + c) % 11)) for c in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "client LONG, event_id LONG, ts TIMESTAMP_NTZ, latency DOUBLE")
    got = {r.event_id: (r.rolling_sum, r.rolling_n) for r in mo.rolling_last_n(df, 5, block=7).collect()}
    for c in (1, 2):
        seq = sorted([r for r in rows if r[0] == c], key=lambda r: (r[2], r[1]))
        for k, r in enumerate(seq):
            win = seq[max(0, k - 4):k + 1]
            assert got[r[1]] == (sum(x[3] for x in win), len(win))


def test_trailing_rate_halo_bruteforce(spark):
    rows = [(1, i, T0 + dt.timedelta(minutes=13 * i), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "client LONG, event_id LONG, ts TIMESTAMP_NTZ, latency DOUBLE")
    got = {r.event_id: r.rate for r in mo.trailing_rate(df, 3600).collect()}
    for _, eid, t, _ in rows:
        n = sum(1 for _, _, u, _ in rows if t - dt.timedelta(seconds=3600) <= u <= t)
        assert abs(got[eid] - n / 3600.0) < 1e-12


def test_dedup_within_watermark(spark):
    hours = [0, 1, 5, 60, 61, 200]          # at 200 the watermark (61 - 24) has passed the end of the first event's day
    rows = [(1, i, T0 + dt.timedelta(hours=h), "a") for i, h in enumerate(hours)]
    rows += [(2, 100 + i, T0 + dt.timedelta(hours=h), "a") for i, h in enumerate(hours)] + [(1, 200, T0, "b")]
    df = spark.createDataFrame(rows, "client LONG, event_id LONG, ts TIMESTAMP_NTZ, event_type STRING")
    path = ss.land_files(df, "ts", 6, "test-st2")
    s = ss.file_stream(spark, path, df.schema).withColumn("_ets", F.col("ts").cast("timestamp"))
    d = s.withWatermark("_ets", "1 day").dropDuplicatesWithinWatermark(["client", "event_type"]).select("event_id", "client", "event_type")
    out = ss.run_available(d, "test-st2")
    got = {}
    for r in ss.read_sink(spark, out, "event_id long, client long, event_type string").collect():
        got.setdefault((r.client, r.event_type), []).append(hours[r.event_id % 100] if r.event_id != 200 else 0)
    assert set(got) == {(1, "a"), (2, "a"), (1, "b")} and len(got[1, "b"]) == 1
    assert sorted(got[1, "a"]) == sorted(got[2, "a"]) == [0, 200]


def test_result_cache_reads_its_buckets_alone(spark, monkeypatch):
    from moodframe.session import listed, scratch_path
    monkeypatch.setattr(ss, "CACHE_EPOCHS", 3)
    cache, out, schema = scratch_path(spark, "t-cache"), scratch_path(spark, "t-cache-out"), "_th long, text string, score int"
    read = []
    plain = ss.cached_scores

    def seen(spark, folders, buckets, schema):
        got = plain(spark, folders, buckets, schema)
        read.append((set(buckets), {int(f.split("bucket=")[1].split("/")[0]) for f in got.inputFiles()}))
        return got
    monkeypatch.setattr(ss, "cached_scores", seen)
    batches = [[(e * 100 + i, f"text {i + (e % 3)}") for i in range(12)] for e in range(7)] + [[(900, "text 3"), (901, None)]]
    for e in [*range(8), 7, 4]:         # two of them run again
        df = spark.createDataFrame(batches[e], "id long, text string")
        ss.score_with_cache(df, e, cache, out, "text", F.length("text"), schema)
    assert all(files <= buckets for buckets, files in read)
    assert any(0 < len(buckets) <= 2 and files for buckets, files in read)      # the last batch: two buckets of all
    assert any(n.startswith("upto=") for n in listed(spark, cache)) and all(len(ss.cache_folders(spark, cache, e)) <= 4 for e in range(9))
    got = {r.id: r.score for r in ss.read_sink(spark, out, "id long, score int").collect()}
    assert got == {i: None if t is None else len(t) for b in batches for i, t in b}
