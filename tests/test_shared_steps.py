"""Steps that are worked out once for a text."""
from pyspark.sql import functions as F

from moodframe.operators import emotion as em


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_emotion_scores_look_for_a_keyword_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    df = spark.createDataFrame([("happy sad!",), ("",), (None,)], "text string").repartition(1)
    got = df.select(em.emotion_scores(F.col("text")).alias("s"))
    assert _plan(got).count("instr(") < 100
    rows = [r.s for r in got.collect()]
    assert rows[0]["happy"] == rows[0]["sad"] > 0 and abs(sum(rows[0].values()) - 1) < 1e-12
    assert set(rows[1].values()) == set(rows[2].values()) == {0.0}


def test_normalised_by_its_sum(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(em.normalised(F.col("v"))).collect()] == [[0.25, 0.75], [0.0, 0.0], []]
