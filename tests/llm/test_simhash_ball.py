"""Ball hashing against all pairs of a small table."""
import random
import re

import numpy as np
import pytest
import xxhash

from moodframe.llm import simhash_ball as op
from moodframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, bits):
    n, root = len(prints), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_classes(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["Alpha", "beta", "ÀB", "c\x0b", "d\n", "e"]) for _ in range(rng.choice([0, 1, 3, 4, 30, 200]))) for _ in range(30)]
    texts = base + [t + " tail" for t in base] + [None, "", "x\x1cy z\x85 w"]
    ids = [3 * i + 1 for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True)) + [(1, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want_print = {i: plain_print(t) for i, t in rows}
    r = roots(list(want_print.values()), 4)
    want = sorted([(i, f"{p:016x}", ids[k]) for (i, p), k in zip(want_print.items(), r, strict=True)] + [(1, f"{want_print[1]:016x}", ids[r[0]])])
    assert sorted(tuple(x) for x in op.near_duplicates(df).collect()) == want
    kept = op.one_per_group(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for *_, c in want}) and kept.columns == df.columns
    assert op.near_duplicates(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, "q r s t u", 1), (None, "q r s t u", 2), (5, "other words here now", 3), (None, "other words here now", 4)], "doc_id long, text string, fingerprint int")
    assert sorted(x.fingerprint for x in op.one_per_group(lone).collect())[-1] == 3 and op.one_per_group(lone).count() == 2


@pytest.mark.parametrize("bits", [0, 1, 3, 4])
@pytest.mark.parametrize("target", [1 << 20, 3000])
def test_links_find_every_component(spark, monkeypatch, bits, target):
    monkeypatch.setattr(op, "BUCKET_VARIANTS", target)
    monkeypatch.setattr(op, "SLICE_VARIANTS", 5000)
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)} | {0, 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = op.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), bits).collect()
    at = {s: i for i, s in enumerate(signed)}
    got = op.local_roots(np.array([at[e.a] for e in edges], dtype=int), np.array([at[e.b] for e in edges], dtype=int), len(prints))
    assert got.tolist() == roots(prints, bits)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_per_component_where_ids_repeat(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", 1), (1, "one two three four five six seven", 2), (1, "one two three four five six seven", 3),
            (2, "red green blue cyan magenta yellow", 4), (4, "red green blue cyan magenta yellow", 5), (4, "north south east west up down", 6)]
    got = []
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts)
        got.append(sorted((r.doc_id, r.text) for r in op.one_per_group(df).collect()))
        assert sorted(r.n for r in op.one_per_group(df).collect()) in ([1, 2, 4, 6], [1, 3, 4, 6])
    assert got[0] == got[1] == sorted({(r[0], r[1]) for r in rows} - {(4, rows[4][1])})
