"""N-gram counts by blocks against plain Python, and their vocabularies."""
from collections import Counter

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from moodframe.functions import features as fx
from moodframe.functions import text as tx
from moodframe.operators import grams as gr
from moodframe.operators import models as md
from moodframe.operators import tfidf as tf
from moodframe.session import small_batches

TEXTS = ["the cat sat on the mat", "the cat ran", "a 😀😀 b", "x\x00\x00y", "", None, "the cat sat on a hat and the cat sat", "Ünï cödé the cat"]


def _rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_character_stats(spark):
    got = {r.term: (r.df, r.ctf) for r in gr.character_stats(_rows(spark).repartition(2), F.col("text"), 2, 4).collect()}
    each = [Counter(t[i:i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for t in TEXTS if t]
    total = sum(each, Counter())
    assert got == {g: (sum(g in c for c in each), n) for g, n in total.items()}
    assert got["😀😀"] == (1, 1)        # a character beyond the first plane is one character


@pytest.mark.parametrize("k, min_df, max_df, candidates", [(5, 1, 1.0, 200_000), (12, 2, 0.6, 200_000), (500, 1, 1.0, 200_000), (5, 1, 1.0, 2)])
def test_word_vocabulary_is_the_one_of_all_counts(spark, monkeypatch, k, min_df, max_df, candidates):
    monkeypatch.setattr(gr, "CANDIDATES", candidates)
    toks = _rows(spark).where("text is not null").select("doc_id", F.split("text", " ").alias("t")).repartition(3)
    toks = toks.select("doc_id", F.filter("t", lambda w: w != "").alias("t"))
    n = toks.count()
    all_ = tf.vocabulary(tf.term_stats(toks, tf.word_ngrams(F.col("t"), 1, 3)), n, k, min_df, max_df)
    vocab = tf.word_vocabulary(toks, F.col("t"), n, k, min_df, max_df)
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, all_.collect()))
    counted = tf.term_counts(toks, "doc_id", F.col("t"), vocab).collect()
    terms = {r.term for r in vocab.collect()}
    want = Counter()
    for d, t in toks.collect():
        for m in (1, 2, 3):
            want.update((d, g) for i in range(len(t) - m + 1) if (g := " ".join(t[i:i + m])) in terms)
    assert {(r.doc_id, r.term): r.tf for r in counted} == dict(want)


def test_no_words_at_all(spark):
    toks = spark.createDataFrame([(1, [])], "doc_id long, t array<string>")
    vocab = tf.word_vocabulary(toks, F.col("t"), 1, 5)
    assert vocab.count() == 0 and tf.term_counts(toks, "doc_id", F.col("t"), vocab).count() == 0


def test_vocabularies_need_no_stored_grams(spark):
    """only texts and dense features are kept."""
    words, chars = md.fit_vocabularies(md.dense_columns(_rows(spark).where("text is not null")), 10, 10)
    assert "the" in {r.term for r in words} and len(chars) == 10


def test_svd_makes_its_rows_once(spark):
    """the iteration doesn't go back to the texts."""
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return (Vectors.sparse(150, {i: 1.0, 149 - 2 * i: 2.0}),)
    df = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(row), spark.createDataFrame([(Vectors.dense([1.0]),)], ["v"]).schema)
    values, _ = md.truncated_svd(df, "v", 5)
    assert len(values) == 5 and made.value <= 80


def test_mean_vector_joins_where_the_words_stand(spark):
    """few vectors are broadcast, many are shuffled, the mean is the same."""
    vectors = spark.createDataFrame([("the", [1.0, 2.0]), ("cat", [3.0, 0.0])], "word string, vec array<double>")
    few, many = (fx.mean_word_vector(_rows(spark), "doc_id", "text", vectors, broadcast_max=n) for n in (10, 1))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert few._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_batches_are_bounded(spark):
    """F9, F10, F23."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for before, after in (("10000", "2048"), ("0", "2048"), ("100", "100")):
        spark.conf.set(name, before)
        small_batches(spark)
        assert spark.conf.get(name) == after


def test_cleaning_in_one_replacement(spark):
    """as by the single steps X1-X8."""
    texts = ["I cannot gonna cannots wanna", "a_b 12 ½x Ⅷ ΑΣ'α İx", "<b>don't</b> go  the\x0bend", "", None, "   ", "naïve😀word"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    x = tx.digits_to_space(tx.non_word_to_space(tx.nfc(tx.strip_tags("t"))))
    old = tx.remove_stop_words(tx.split_contractions(tx.split_ws(F.lower(x))))
    got = df.select(tx.clean_tokens("t").alias("new"), old.alias("old"))
    assert all(r.new == r.old for r in got.collect())
    assert "array_contains" not in df.select(tx.clean_tokens("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_blank_texts_have_no_words(spark):
    """F25, F27."""
    df = spark.createDataFrame([(" \n. . ",), ("",), ("The cat. . Sat.",)], "t string")
    rows = [r.asDict() for r in df.select(*fx.linguistic(F.col("t")), *fx.emotion(F.col("t")), *fx.statistical(F.col("t"), ["cat"])).collect()]
    assert [r["l1_sentences"] for r in rows] == [0, 0, 2] and [r["f2_words"] for r in rows] == [3 - 1, 0, 4]
    assert rows[2]["f9_lexicon_ratio"] == 0.0 and rows[2]["l6_stop_ratio"] == 0.25


def test_variants_are_made_once(spark):
    """no filter on the text below the aggregate."""
    from moodframe.operators import synthesize as sy
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    df = spark.createDataFrame([(1, 2, "one two three four")], "doc_id long, label int, t string").repartition(1)
    plan = sy.synthetic_variants(df, "t", "doc_id", "label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter (isnotnull(_n") < plan.index("Aggregate") and not any("Quick note" in x for x in plan.splitlines() if "Filter" in x)
