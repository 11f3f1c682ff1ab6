"""Label coercion, preprocessing and class counts."""
from pyspark.sql import functions as F

from moodframe.operators import dataset as ds

LABEL_CASES = [("0", 0), ("1", 1), ("2", 2), ("3", None), ("-1", None), ("1.7", 1), ("2.0", 2),
               ("positive", 2), ("NEGATIVE", 0), ("", None), (None, None)]


def test_coerce_label(spark):
    df = spark.createDataFrame(LABEL_CASES, "label STRING, expected INT")
    for r in df.select(ds.coerce_label("label").alias("got"), "expected", "label").collect():
        assert r.got == r.expected, r
    strict = {r.label: r.got for r in df.select("label", ds.coerce_label("label", accept_names=False).alias("got")).collect()}
    assert strict["positive"] is None and strict["1.7"] == 1


def test_emotion_id_and_rating(spark):
    ids = spark.createDataFrame([(i,) for i in range(15)] + [(None,)], "id INT")
    got = [r.s for r in ids.select(ds.fine_to_sentiment("id").alias("s")).collect()]
    assert got[:15] == [0, 1, 2, 2, 2, 2, 2, 0, 0, 0, 0, 1, 1, 1, 1] and got[15] == 1
    ratings = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (0,), (None,)], "score INT")
    assert [r.s for r in ratings.select(ds.rating_to_sentiment("score").alias("s")).collect()] == [0, 0, 1, 2, 2, 0, 1]


def test_preprocess_min_length_and_default_label(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, None), (4, "the is abcd")], "id INT, text STRING")
    out = {r.id: (r.cleaned_text, r.label) for r in ds.preprocess(df).collect()}
    assert out == {2: ("abcd", 1), 4: ("abcd", 1)}


def test_class_counts_absent_class(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "label INT")
    assert {r.label: r.n for r in ds.class_counts(df).collect()} == {0: 2, 1: 0, 2: 1}


def test_dedup_keep_first(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "id INT, text STRING, v STRING")
    got = sorted((r.text, r.id, r.v) for r in ds.dedup_keep_first(df, "text", "id").collect())
    assert got == [("a", 1, "y"), ("b", 2, "z")]


def test_features_and_labels_raises_when_empty(spark):
    import pytest
    ok = spark.createDataFrame([("abcd", 1), ("efgh", 7)], "cleaned_text STRING, label INT")
    assert ds.features_and_labels(ok).count() == 1
    bad = spark.createDataFrame([("abcd", 7)], "cleaned_text STRING, label INT")
    with pytest.raises(ValueError):
        ds.features_and_labels(bad)
