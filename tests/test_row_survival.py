"""Null keys and labels, small blocks, absent classes: no row is lost, no job stops."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from moodframe.operators import augment as ag
from moodframe.operators import evaluate as ev
from moodframe.operators import monitor as mo
from moodframe.operators import sampling as sm
from moodframe.streaming import streams as ss


def events(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 10, i % 10), None if i % 3 == 0 else i % 2, float(i), i % 5 != 0) for i in range(30)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, client long, latency double, available boolean")


def test_null_keys_stay(spark):
    e = events(spark)
    assert mo.status_segments(e, "client", "ts", "event_id", "available").count() == 30
    assert mo.admission_by_session(e, 2, 7200).count() == 30
    assert mo.admission_exact(e, 2, 7200).count() == 30


@pytest.mark.parametrize(("n", "block"), [(20, 7), (20, 100), (3, 1), (1, 4)])
def test_rolling_over_any_block(spark, n, block):
    got = {r.event_id: r for r in mo.rolling_last_n(events(spark), n, block=block).collect()}
    assert len(got) == 30
    for i, r in got.items():
        own = [j for j in range(i + 1) if (j % 3 == 0) == (i % 3 == 0) and (i % 3 == 0 or j % 2 == i % 2)][-n:]
        assert (r.rolling_n, r.rolling_sum) == (len(own), sum(own))


def test_null_labels_are_a_class(spark):
    df = spark.createDataFrame([(i, None if i < 10 else i % 2) for i in range(40)], "doc_id long, label int")
    split = sm.stratified_split(df)
    assert split.count() == 40 and split.where("label is null and split = 'test'").count() == 3
    assert sm.class_weights(df).count() == 40 and sm.stratified_folds(df).count() == 40
    assert sm.oversample(df).groupBy("label").count().select("count").distinct().collect() == [(15,)]


def test_null_group_and_absent_class(spark):
    df = spark.createDataFrame([(1, 1, None), (0, 1, None), (1, 1, "a"), (None, 0, "b")], "label int, prediction int, lang string")
    got = {r.lang: r.accuracy for r in ev.grouped_scores(df, ["lang"]).collect()}
    assert got == {None: 0.5, "a": 1.0, "b": 0.0}
    s = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.3, 0.6, 0.1]), (1, [0.5, None, 0.1])], "label int, probs array<double>")
    auc = {r.cls: r.auc for r in ev.ovr_auc(s).collect()}
    assert auc == {0: 1.0, 1: 1.0, 2: None}
    assert {r.tpr for r in ev.roc_points(s).where("cls = 2").collect()} == {None}


def test_log_filters(spark):
    lines = ["2024-01-02 00:00:00,000 - api - INFO - API Server starting", "2024-01-02 00:00:00,000 - api - INFO - Request: GET /initiate",
             "2024-01-02 00:00:00,000 - api - INFO - again Request: GET /x Status: 5001", "odd line"]
    p = mo.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    def kept(**kw):
        return [lines.index(r.value) for r in mo.filter_logs(p, **kw).collect()]
    assert kept(kind="init") == [0] and kept(kind="request") == [1, 2] and kept(path="/initiate") == [1]
    assert kept(status=500) == [2] and kept(since="2024-02-01 00:00:00") == [3] and kept() == [0, 1, 2, 3]


def test_typo_keeps_the_end_of_a_long_word(spark):
    w = "q" * 1_200_000
    got = spark.createDataFrame([(1, [w])], "k long, w array<string>").select(F.length(ag.apply_typos(F.col("w"), F.col("k"), rate=1.0)[0])).first()[0]
    assert got == len(w)


def test_cache_batch_run_twice(spark, tmp_path):
    cache, out = f"file://{tmp_path}/cache", f"file://{tmp_path}/out"
    batches = [spark.createDataFrame([(1, "a"), (2, "b")], "i long, text string"), spark.createDataFrame([(3, "a"), (4, "c"), (5, None)], "i long, text string")]
    for epoch in (0, 1, 1, 0):
        ss.score_with_cache(batches[epoch], epoch, cache, out, "text", F.length("text"), "_th long, text string, score int")
    got = sorted(tuple(r) for r in ss.read_sink(spark, out, "i long, score int").collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (5, None)]
    assert sorted(r.text or "" for r in ss.read_sink(spark, cache, "_th long, text string, score int").collect()) == ["", "a", "b", "c"]
    assert ss.read_sink(spark, f"file://{tmp_path}/none", "i long").count() == 0


def test_results_dont_depend_on_bucket_widths(spark):
    e = events(spark)
    def segments(width):
        return sorted(map(tuple, mo.status_segments(e, "client", "ts", "event_id", "available", width).select("event_id", "segment").collect()))
    def rates(n):
        return sorted(map(tuple, mo.trailing_rate(e, 7200, per_bucket=n).select("event_id", "rate").collect()))
    assert segments(None) == segments(90.0) == segments(0.5)
    assert rates(1) == rates(4) == rates(1000)
    assert mo.bucket_width(e, "client", "ts") == 86400 and mo.bucket_width(e, "client", "ts", 2) == 43200
