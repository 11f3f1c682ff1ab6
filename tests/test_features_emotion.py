"""Feature columns and emotion scoring against values worked out by hand."""
import pytest
from pyspark.sql import functions as F

from moodframe.functions import features as fx
from moodframe.functions import lexicon as lx
from moodframe.operators import emotion as em

STATISTICS = {
    "": dict(f1_chars=0, f2_words=0, f4_unique_chars=0, f10_exclaim=0, f12_emoji=0, f13_caps_word_ratio=0, f14_word_len_var=0, f17_exclaim_runs=0, f20_pos_emoticons=0, f21_neg_emoticons=0, f22_face_emoji=0),
    "word": dict(f1_chars=4, f2_words=1, f4_unique_chars=4, f10_exclaim=0, f12_emoji=0, f13_caps_word_ratio=0, f14_word_len_var=0, f17_exclaim_runs=0),
    "ALL CAPS HERE": dict(f1_chars=13, f2_words=3, f4_unique_chars=9, f13_caps_word_ratio=1, f14_word_len_var=2 / 9),
    "!!! !": dict(f1_chars=5, f2_words=2, f4_unique_chars=2, f10_exclaim=4, f17_exclaim_runs=2, f14_word_len_var=1),
    ":-) ;p :(": dict(f1_chars=9, f2_words=3, f20_pos_emoticons=2, f21_neg_emoticons=1, f14_word_len_var=2 / 9),
    "face 😀 and 🎉 party": dict(f1_chars=18, f2_words=5, f12_emoji=2, f22_face_emoji=1, f13_caps_word_ratio=0),
    "I am so happy and sad. Let down!": dict(f1_chars=32, f2_words=8, f10_exclaim=1, f13_caps_word_ratio=1 / 8, f14_word_len_var=119 / 64),
}


def test_statistical(spark):
    df = spark.createDataFrame([(t,) for t in STATISTICS], "text STRING")
    for r in df.select("text", *fx.statistical(F.col("text"))).collect():
        for name, value in STATISTICS[r.text].items():
            assert r[name] == pytest.approx(value), (r.text, name)


def test_emotion_features(spark):
    df = spark.createDataFrame([("I am so happy and sad today ok",), ("",)], "text STRING")
    got = {r.text: r for r in df.select("text", *fx.emotion(F.col("text"))).collect()}
    hit = got["I am so happy and sad today ok"]
    assert hit["e_happy"] == pytest.approx(1 / 8) and hit["e_sad"] == pytest.approx(1 / 8) and hit["e_angry"] == 0
    assert all(got[""][f"e_{e}"] == 0 for e in lx.EMOTIONS_SORTED)


def test_emotion_scores_and_pick(spark):
    cases = [("nothing here", 2, "happy"), ("I am sad and angry!", 0, "sad"), ("so happy, great", 2, "happy"),
             ("shocked and puzzled", 1, "surprised"), ("let down, unhappy", 0, "sad")]
    df = spark.createDataFrame(cases, "text STRING, sentiment INT, expected STRING")
    scored = df.withColumn("s", em.emotion_scores(F.col("text")))
    out = {r.text: r for r in scored.select("text", "expected", "s", em.pick_emotion(F.col("s"), F.col("sentiment")).alias("p")).collect()}
    assert all(r.p == r.expected for r in out.values())
    assert set(out["nothing here"].s.values()) == {0.0}
    both = out["I am sad and angry!"].s          # one keyword each, the mark weighs both alike
    assert both["sad"] == pytest.approx(0.5) and both["angry"] == pytest.approx(0.5)
