"""Exact neighbours by pivots against all distances."""
import numpy as np
import pytest

from moodframe.operators import pivots as pv


def plain(rows, asked, k):
    out = {}
    for c, base in asked:
        own = next(r for r in rows if r[:2] == (c, base))
        other = [(float(sum((p - q) ** 2 for p, q in zip(own[3], r[3], strict=True))), r[2], r[1]) for r in rows if r[0] == c and r[1] != base]
        out[c, base] = [x[2] for x in sorted(other)[:k]]
    return out


@pytest.mark.parametrize(("block", "cell", "rings", "k"), [(5, 10, 4, 3), (4096, 1024, 64, 5), (3, 30, 2, 1), (7, 4, 64, 40)])
def test_neighbours_are_those_of_all_distances(spark, monkeypatch, block, cell, rings, k):
    monkeypatch.setattr(pv, "BLOCK_ROWS", block)
    monkeypatch.setattr(pv, "CELL_ROWS", cell)
    monkeypatch.setattr(pv, "RINGS", rings)
    monkeypatch.setattr(pv, "BLOCK", 50)
    rng = np.random.default_rng(block)
    # whole numbers tie; a third of class 1 is one vector; class 2 is tiny
    vectors = [(1, rng.integers(0, 12, 3)) for _ in range(100)] + [(1, np.array([4, 4, 4])) for _ in range(50)] + [(3, rng.integers(0, 4, 3) * 100) for _ in range(40)] + [(2, np.array([i, 0, 0])) for i in range(3)]
    at, rows = {}, []
    for c, v in [vectors[i] for i in rng.permutation(len(vectors))]:
        at[c] = at.get(c, -1) + 1
        rows.append((c, at[c], int(rng.integers(0, 60)), [float(x) for x in v]))      # ids repeat
    asked = [r[:2] for r in rows if rng.random() < 0.6 or r[0] == 2]
    df = spark.createDataFrame(rows, "c int, at long, id long, v array<double>").repartition(5)
    got = pv.neighbours_in_class(df, spark.createDataFrame(asked, "c int, base long"), k).collect()
    assert len(got) == len(asked) and {(r.c, r.base): r.best for r in got} == plain(rows, asked, k)


def test_only_cells_within_the_bound_are_reached(spark):
    pivots = {0: np.array([[1000.0 * i, 0.0] for i in range(20)])}
    reach = {0: (np.zeros(20), np.array([2.0] * 18 + [2500.0, -np.inf]))}     # cell 18 is wide, cell 19 holds no row
    reach[0][0][19] = np.inf
    schema = "c int, lead long, v array<double>, bound double, cell int, ring int, sub int"
    home = spark.createDataFrame([(0, 1, [3000.0, 1.0], 5.0, 3, 0, 0), (0, 2, [16000.0, 0.0], 5.0, 16, 0, 0), (0, 3, [0.0, 0.0], float("inf"), 0, 0, 0)], schema)
    got = {}
    for r in pv.reached(home, pivots, reach, "int").collect():
        got.setdefault(r.lead, set()).add(r.cell)
    assert got == {1: {3}, 2: {16, 18}, 3: set(range(20))}


def test_empty_and_single(spark):
    df = spark.createDataFrame([(0, 0, 9, [1.0])], "c int, at long, id long, v array<double>")
    ask = spark.createDataFrame([(0, 0)], "c int, base long")
    assert [r.best for r in pv.neighbours_in_class(df, ask, 2).collect()] == [[]]
    assert pv.neighbours_in_class(df, ask.limit(0), 2).count() == 0
