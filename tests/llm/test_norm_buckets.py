"""Ranked search against plain Python."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from moodframe.llm import norm_buckets as nb

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, rank int, score string, n long", "item_id long, text string, rank int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, all_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = {}
    for i, q in queries.items():
        scored = []
        for d, c in counted:
            if c:
                m = 50 + (50 * sum(c.values()) * n_docs) // all_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in q if c[t])
                if s > 0:
                    scored.append((-s, d is None, d))
        if scored:
            out[i] = [(d, -s) for s, _, d in sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def found(docs, items, k):
    out = {}
    for r in sorted(nb.ranked_search(docs, items, k).collect(), key=lambda r: (str(r.item_id), r.rank)):
        assert r.rank == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def case(seed, n_docs=400, n_items=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ÉCOLE", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(0, 60))).upper()) for i in range(n_docs)]
    docs += [(1000, None), (1001, ""), (1002, "-- !"), (None, docs[3][1]), docs[5], docs[5], (2000, "w0 w1 w2 " * 5000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 25)))) for i in range(n_items)] + [(50, None), (51, ""), (52, "absent"), (0, "w7 w8"), (None, "w9 é")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1, "s", 5) for d, t in docs], DOCS).repartition(4), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(nb, "SEED_ROWS", 40)
    docs, items = case(seed)
    assert found(*frames(spark, docs, items), k=7) == brute(docs, items, 7)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_CELLS", 60)
    docs, items = case(3, 100, 5)
    d, i = frames(spark, docs, items)
    assert len(list(nb.blocks(nb.items_of(i)))) > 2
    assert found(d, i, k=5) == brute(docs, items, 5)


def test_many_copies_and_ties(spark):
    docs = [(i, "alpha beta gamma") for i in range(700)] + [(i, f"alpha w{i}") for i in range(700, 1500)]
    items = [(1, "alpha"), (2, "gamma beta")]
    got = found(*frames(spark, docs, items), k=50)
    assert got == brute(docs, items, 50) and [d for d, _ in got[2]] == list(range(50))


def test_empty_tables(spark):
    docs, items = frames(spark, *case(4, 20, 2))
    assert found(docs.limit(0), items, 5) == {} and found(docs, items.limit(0), 5) == {} and found(docs.filter("doc_id = 1000"), items, 5) == {}


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(1)
    weights, ends, terms, impacts = r.integers(1, 9000, 200).astype(float), [0], [], []
    for _ in range(300):
        own = np.sort(r.choice(200, r.integers(1, 40), replace=False))
        terms.append(own)
        impacts.append(r.integers(1, 10**6, len(own)))
        ends.append(ends[-1] + len(own))
    ends, terms, impacts = np.array(ends), np.concatenate(terms), np.concatenate(impacts)
    lengths = np.sqrt(np.add.reduceat(weights[terms] * impacts.astype(float) ** 2, ends[:-1]))
    queries = [np.sort(r.choice(200, n, replace=False)) for n in (1, 5, 30)]
    dense = np.zeros((300, 200), dtype=np.int64)
    dense[np.repeat(np.arange(300), np.diff(ends)), terms] = impacts
    block = nb._Queries(queries, weights.astype(np.int64))
    for q, own in enumerate(queries):
        exact = (dense[:, own] * weights[own].astype(np.int64)).sum(axis=1)
        for least in (1, int(np.sort(exact)[-10]), int(exact.max())):
            limits = np.full(3, np.iinfo(np.int64).max // 2)
            limits[q] = least
            got = {int(i): int(s) for n, rows, scores in nb._bucket_scores(block, weights, limits, ends, terms, impacts, lengths) for i, s in zip(rows, scores, strict=True)}
            assert got == {i: int(s) for i, s in enumerate(exact) if s >= least}
        none = np.full(3, int(block.length.max() * lengths.max()) + 10)
        assert not list(nb._bucket_scores(block, weights, none, ends, terms, impacts, lengths))
