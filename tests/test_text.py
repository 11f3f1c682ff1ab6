"""Cleaning and parsers against values worked out by hand."""
from pyspark.sql import functions as F

from moodframe.functions import text as tx


#: text -> cleaned English, cleaned with the substring rule of ``compat``
CLEANED = {
    "": ("", ""),
    "   ": ("", ""),
    "a<b>bold</b>c and <i>x</i>": ("aboldc x", "aboldc and x"),
    "digits 123 and_under_score x2y": ("digits score x", "digits and under score x y"),
    "emoji 😀 here!": ("emoji", "emoji here"),
    "abc": ("abc", "abc"),
    "this is the thing": ("thing", "this the thing"),
    "Ünïcödé ÉCOLE": ("ünïcödé école", "ünïcödé école"),
    "Cafe\u0301 <br>": ("caf\u00e9", "caf\u00e9"),
}


def test_clean(spark):
    df = spark.createDataFrame([(t,) for t in CLEANED], "text STRING")
    for r in df.select("text", tx.clean_text(F.col("text"), "en", False).alias("plain"), tx.clean_text(F.col("text"), "en", True).alias("compat")).collect():
        assert (r.plain, r.compat) == CLEANED[r.text], r.text


def test_null_text_is_null(spark):
    df = spark.createDataFrame([(None,)], "text STRING")
    assert df.select(tx.clean_text(F.col("text")).alias("c")).first().c in (None, "")


def test_vi_compound_protects_stop_word(spark):
    df = spark.createDataFrame([("tôi có thể đi và về",), ("và có",)], "text STRING")
    got = [r.c for r in df.select(tx.clean_text(F.col("text"), "vi").alias("c")).collect()]
    assert got == ["tôi có thể đi về", ""]


def test_reactions_and_small_parsers(spark):
    rows = [("12 likes and 3 HAHA",), ("5 thích, 2 buồn",), ("7 people",), ("nothing",)]
    df = spark.createDataFrame(rows, "t STRING")
    r = df.select(tx.reaction_counts(F.col("t")).alias("r")).collect()
    assert (r[0].r.total, r[0].r.types) == (15, {"like": 12, "haha": 3})
    assert (r[1].r.total, r[1].r.types) == (7, {"like": 5, "sad": 2})
    assert (r[2].r.total, r[2].r.types) == (7, {})
    assert (r[3].r.total, r[3].r.types) == (0, {})
    lab = spark.createDataFrame([("Comment by Ann ",), ("Trả lời bởi Bình",), ("Reply by X",)], "t STRING")
    assert [x.a for x in lab.select(tx.author_from_label(F.col("t")).alias("a")).collect()] == ["Ann", "Bình", None]
    rel = spark.createDataFrame([("5h",), ("10x",), ("2D",)], "t STRING")
    assert [x.s for x in rel.select(tx.relative_time_seconds(F.col("t")).alias("s")).collect()] == [18000, None, 172800]
    lang = spark.createDataFrame([("hello",), ("xin chào bạn",), ("123",)], "t STRING")
    assert [x.l for x in lang.select(tx.detect_language(F.col("t")).alias("l")).collect()] == ["en", "vi", "vi"]


def test_numbers_too_large_dont_stop_the_job(spark):
    big = "9" * 25
    df = spark.createDataFrame([(f"{big} likes, 4 haha",), (f"{big} people",), (f"{big}h",), ("2147483647 likes 2147483647 haha",)], "t STRING")
    r = df.select(tx.reaction_counts(F.col("t")).alias("r"), tx.first_integer(F.col("t")).alias("i"), tx.relative_time_seconds(F.col("t")).alias("s")).collect()
    assert (r[0].r.total, r[0].r.types, r[0].i) == (4, {"haha": 4}, None)
    assert (r[1].r.total, r[2].s, r[3].i) == (0, None, 2147483647)
