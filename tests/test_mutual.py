"""Mutual information by neighbour distances."""
import math
import random

import pytest

from moodframe.operators import mutual as mu


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(rows, k):
    """rows: (label, whole number)"""
    size = {c: sum(1 for d, _ in rows if d == c) for c, _ in rows}
    rows = [r for r in rows if size[r[0]] > 1]
    total = 0.0
    for i, (c, x) in enumerate(rows):
        kc = min(k, size[c] - 1)
        r = sorted(abs(x - y) for j, (d, y) in enumerate(rows) if d == c and j != i)[kc - 1]
        m = sum(1 for _, y in rows if abs(x - y) < r or x == y)
        total += psi(kc) - psi(size[c]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


def test_digamma(spark):
    got = spark.range(1, 400).select("id", mu.digamma(mu.F.col("id")).alias("p")).collect()
    assert all(math.isclose(r.p, psi(r.id), abs_tol=1e-10) for r in got)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:       # many ranges and blocks
        monkeypatch.setattr(mu, "RANGE_ROWS", 9)
        monkeypatch.setattr(mu, "BLOCK_RANKS", 5)
    r = random.Random(4)
    rows = [(c, r.randint(0, 400) + 150 * c, r.randint(0, 5), 7 if i % 3 else r.randint(0, 9)) for i in range(150) for c in (r.choice([0, 0, 0, 1, 2]),)]
    rows += [(3, 1, 2, 3), (4, 5, 5, 5), (4, 900, 5, 5)]           # classes of one and of two rows
    extra = [(None, 1, 1, 1), (0, None, None, None)]
    df = spark.createDataFrame([(c, None if a is None else a / 1e6, b, float("nan") if d is None else float(d), None) for c, a, b, d in rows + extra],
                               "label INT, a DOUBLE, b INT, d DOUBLE, empty DOUBLE").repartition(3)
    for k in (1, 3):
        got = {x.feature: x.mi for x in mu.neighbour_information(df, ["a", "b", "d", "empty"], k=k).collect()}
        want = {f: brute([(x[0], x[i]) for x in rows], k) for i, f in enumerate("abd", 1)}
        assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], abs_tol=1e-9) for f in want)


def test_without_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "label INT, a DOUBLE")
    assert mu.neighbour_information(df, ["a"]).count() == 0 and mu.neighbour_information(df.limit(0), ["a"]).count() == 0
