"""Synthetic minority rows."""
import numpy as np

from moodframe.operators import pivots as pv
from moodframe.operators import smote as so


def test_draws_lie_between_near_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(size=3).tolist()) for i in range(40)] + [(100 + i, 1, [10.0 + i, 0.0, 0.0]) for i in range(6)] + [(200, 2, [1.0, 1.0, 1.0]), (300, None, [0.0] * 3), (301, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, label int, vec array<double>")
    got = {p: sorted((r.label, r.draw, tuple(r.vec)) for r in so.smote(df.repartition(p), "vec", k=2).collect()) for p in (1, 5)}
    assert got[1] == got[5] and len(got[1]) == 34 and {r[0] for r in got[1]} == {1}      # a class of one row gives none
    assert all(10 <= v[0] <= 15 and v[1:] == (0.0, 0.0) for _, _, v in got[1])
    assert so.smote(df.limit(0), "vec").count() == 0


def test_neighbours_are_exact_and_ties_go_by_id(monkeypatch):
    monkeypatch.setattr(pv, "BLOCK", 10)
    m = np.array([[0.0], [1.0], [1.0], [-1.0], [5.0]])
    assert so.neighbours(m, np.array([9, 4, 3, 8, 1]), np.array([0, 4]), 3).tolist() == [[2, 1, 3], [2, 1, 0]]


def test_all_rows_of_a_class_take_part(spark, monkeypatch):
    monkeypatch.setattr(pv, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(i, 0, rng.integers(0, 9, 2).astype(float).tolist()) for i in range(260)] + [(1000 + i, 1, rng.integers(0, 9, 2).astype(float).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label int, vec array<double>")
    got = {r.draw: tuple(r.vec) for r in so.smote(df, "vec", k=3).collect()}
    monkeypatch.setattr(pv, "BLOCK_ROWS", 4096)
    assert {r.draw: tuple(r.vec) for r in so.smote(df, "vec", k=3).collect()} == got and len(got) == 220
    ranked = {r["_rank"] - 1: r for r in so.class_ranked(df.where("label = 1"), "label", "doc_id", 42, "smote").collect()}
    u = lambda salt: so.hz.u01(so.F.lit(1), 42, salt, so.F.col("draw"))
    for r in spark.range(1, 221).select(so.F.col("id").alias("draw")).select("draw", u("smoteb").alias("b"), u("smoten").alias("n"), u("smoteg").alias("g")).collect():
        a = ranked[int(r.b * 40)]
        others = sorted((x for i, x in ranked.items() if i != int(r.b * 40)), key=lambda x: (sum((p - q) ** 2 for p, q in zip(a.vec, x.vec, strict=True)), x.doc_id))
        z = others[int(r.n * 3)]
        assert np.allclose(got[r.draw], [p + r.g * (q - p) for p, q in zip(a.vec, z.vec, strict=True)])



def test_non_finite_vectors_count_but_are_not_drawn_from(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(9)] + [(20 + i, 1, [float(i), 5.0]) for i in range(3)] + [(30, 1, [float("nan"), 5.0]), (31, 1, [float("inf"), 5.0]), (32, 1, [None, 5.0])]
    df = spark.createDataFrame(rows, "doc_id long, label int, vec array<double>")
    got = so.smote(df, "vec", k=2).collect()
    assert len(got) == 3 and all(0 <= r.vec[0] <= 2 and r.vec[1] == 5.0 for r in got)
