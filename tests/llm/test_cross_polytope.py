"""Nearest neighbours against an exhaustive search."""
import numpy as np
import pytest

from moodframe.llm import cross_polytope as cp
from moodframe.sources.tables import table

SF = "/root/testdata/sf0.001"

SCHEMA = "vec_id long, embedding array<float>, label int, score string, h1 int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "s", 7) for i, x in rows], SCHEMA)


def brute(rows, every=100, k=10):
    out = {}
    for q, x in rows:
        if q % every == 0:
            away = sorted((float(np.sqrt(((np.float32(x).astype(float) - np.float32(y).astype(float)) ** 2).sum())), i) for i, y in rows if i != q and len(y) == len(x))
            out[q] = [(i, d) for d, i in away[:k]]
    return out


def found(df, **settings):
    out = {}
    for r in sorted(cp.nearest(df, **settings).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return {q: [x[1:] for x in rows] for q, rows in out.items()}


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([i in {j for j, _ in want[q]} for q in want for i, _ in got[q]])


def test_hadamard_is_orthonormal():
    h = cp.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_probes_are_the_cheapest_buckets():
    x = np.random.default_rng(0).normal(size=(5, 6))
    for parts in (1, 2, 3):
        h = cp.Hash(6, 2, parts, 40)
        turned, probed = h.turned(x, 1), h.probed(x, 1)
        assert (probed[:, 0] == h.buckets(x, 1)).all()
        for row in range(5):
            all_costs = np.zeros(1)
            for y in turned:
                all_costs = (all_costs[:, None] + (y[row].max() - y[row])[None, :] ** 2).ravel()
            assert len(set(probed[row])) == probed.shape[1] and np.allclose(all_costs[probed[row]], np.sort(all_costs)[:probed.shape[1]])


@pytest.mark.parametrize("scale", [False, True])
def test_recall_on_given_rows(spark, scale):
    rows = [(r.vec_id, [float(v) * (1 + r.vec_id % 7 if scale else 1) for v in r.embedding]) for r in table(spark, SF, "embeddings").collect()]
    got, want = found(frame(spark, rows), every=10), brute(rows, every=10)
    assert recall(got, want) >= 0.9
    for q in want:
        exact = dict(brute([(q, dict(rows)[q])] + [(i, dict(rows)[i]) for i, _ in got[q]], every=10 ** 9).get(q, [])) or {i: d for i, d in want[q]}
        assert all(abs(exact[i] - d) < 1e-12 for i, d in got[q] if i in exact)


def test_clustered_rows_use_more_parts_and_few_comparisons(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(400, 32))
    rows = [(i, (centres[i % 400] + 0.05 * r.normal(size=32)).tolist()) for i in range(6000)]
    got, want = found(frame(spark, rows)), brute(rows)
    assert recall(got, want) >= 0.9
    sample = np.array([np.float32(x) for _, x in rows[:4000]], dtype=float)
    fit = cp.Fit(sample, 10**8, 10**6, 10, 2, 0.98)
    assert fit.hash.parts >= 2


def test_hot_copies_ties_and_bad_vectors(spark):
    r = np.random.default_rng(5)
    same = r.normal(size=8).tolist()
    rows = [(i, same) for i in range(0, 600, 2)] + [(i, r.normal(size=8).tolist()) for i in range(1, 600, 2)]
    bad = [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [float("nan")] * 8), (1400, [float("inf")] + [1.0] * 7), (1500, [None] + [1.0] * 7), (None, [1.0] * 8)]
    got = found(frame(spark, rows + bad + rows[:5] * 3))
    want = brute(rows)
    assert got == {q: [(i, 0.0) for i in (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20) if i != q][:10] for q in want}


def test_salted_buckets_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, (np.ones(16) + 0.01 * r.normal(size=16)).tolist()) for i in range(900)]
    monkeypatch.setattr(cp, "BLOCK", 50)
    monkeypatch.setattr(cp, "QUERY_BLOCK", 2)
    assert recall(found(frame(spark, rows), every=30), brute(rows, every=30)) >= 0.9


def test_few_rows_lengths_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (100, [1.0, 2.0, 3.0]), (101, [-1.0, -2.0, -3.0]), (200, [5.0])]
    want = brute(rows)
    got = found(frame(spark, rows))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert found(frame(spark, [])) == {} and found(frame(spark, [(100, None)])) == {}


def test_too_few_found_are_searched_everywhere(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=16).tolist()) for i in range(300)]
    fitted = cp.Fit.__init__

    def one_probe(self, sample, *a):
        fitted(self, sample, *a)
        self.hash = cp.Hash(16, 2, 1, 1)
        self.bounds = lambda q: np.full(len(q), np.inf)
    monkeypatch.setattr(cp.Fit, "__init__", one_probe)
    monkeypatch.setattr(cp.Fit, "bounds", lambda self, q: np.full(len(q), np.inf))
    got = cp.nearest(frame(spark, rows), every=100, k=60).collect()
    want = brute(rows, k=60)
    assert {(x.query_id, x.vec_id) for x in got} == {(q, i) for q in want for i, _ in want[q]}
