"""Histogram-cut ranking, partition invariance, voting and metrics."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from moodframe.operators import evaluate as ev
from moodframe.operators import sampling as sm


def _rows(spark, n=500):
    return spark.createDataFrame([(i, i % 3 if i % 7 else 0) for i in range(n)], "doc_id LONG, label INT")


def test_rank_equals_row_number(spark):
    df = _rows(spark)
    r = sm.class_ranked(df, "label", "doc_id", max_bucket_rows=20)  # forces multi-digit buckets
    w = Window.partitionBy("label").orderBy("_h", "doc_id")
    ref = df.withColumn("_h", sm.sort_hash(F.col("doc_id"))).withColumn("rn", F.row_number().over(w))
    got = {x.doc_id: x._rank for x in r.collect()}
    assert got == {x.doc_id: x.rn for x in ref.collect()}


def test_split_partition_invariant(spark):
    outs = []
    for parts in (1, 3, 17):
        df = _rows(spark).repartition(parts)
        outs.append(sorted((r.doc_id, r.split) for r in sm.stratified_split(df).collect()))
    assert outs[0] == outs[1] == outs[2]


def test_quota_and_oversample(spark):
    df = _rows(spark, 60)
    q = sm.quota_sample(df, {0: 5, 1: 100, 2: 0})
    counts = {r.label: r["count"] for r in q.groupBy("label").count().collect()}
    assert counts.get(0) == 5 and counts.get(1) == df.filter("label = 1").count() and 2 not in counts
    o = sm.oversample(df)
    per = {r.label: r["count"] for r in o.groupBy("label").count().collect()}
    assert len(set(per.values())) == 1


VOTES = [(1, 0, 1, 2, 0), (2, 2, 2, 1, 2), (3, 1, 1, 1, 1), (4, 2, 1, 0, 0)]


def test_hard_vote(spark):
    df = spark.createDataFrame(VOTES, "id INT, p1 INT, p2 INT, p3 INT, expected INT")
    for r in df.select("expected", ev.hard_vote([F.col("p1"), F.col("p2"), F.col("p3")]).alias("v")).collect():
        assert r.v == r.expected


def test_report_edge_classes(spark):
    # class 2 is never predicted; class 3 is predicted but absent from truth
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (1, 3)]
    df = spark.createDataFrame(rows, "label INT, prediction INT")
    rep = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert rep["2"].precision == 0.0 and rep["2"].recall == 0.0 and rep["3"].support == 0
    assert abs(rep["accuracy"].f1 - 2 / 5) < 1e-12


def test_auc_matches_bruteforce(spark):
    import random
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), [round(rnd.random(), 2) for _ in range(3)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "label INT, probs ARRAY<DOUBLE>")
    got = {r.cls: r.auc for r in ev.ovr_auc(df, buckets=8).collect()}
    for c in range(3):
        pos = [p[c] for y, p in rows if y == c]
        neg = [p[c] for y, p in rows if y != c]
        ref = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[c] - ref) < 1e-12
