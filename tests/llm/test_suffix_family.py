"""The index family and whole documents against a plain search."""
import hashlib
import random

import numpy as np
import pytest

from moodframe.llm import suffix_family as op


def plain(docs, size):
    """n_bytes, n_removed, n_spans, kept of each (doc_id, text), doc_ids distinct."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for s in range(len(b) - size + 1):
            w = b[s:s + size]
            if w in seen:
                gone[s:s + size] = 1
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int(((gone[1:] == 0) & (gone[:-1] == 1)).sum()), kept)
    return out


def rows(want):
    return sorted((i, n, g, s, hashlib.sha256(k).hexdigest()) for i, (n, g, s, k) in want.items())


def test_family_takes_batches_in_order():
    rng, seen, family = random.Random(1), set(), op.SuffixFamily(3)
    for _ in range(60):
        x = ["".join(rng.choice("ab\0") for _ in range(3)) for _ in range(rng.randint(1, 9))]
        got = family.add(np.array([[*y.encode(), 1] for y in x], dtype=np.uint8).view("S4").ravel())
        want = []
        for y in x:
            want.append(y in seen)
            seen.add(y)
        assert got.tolist() == want
        sizes = [len(v) for v in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(seen)


@pytest.mark.parametrize(("size", "gram", "hot", "slice_", "batch"), [(20, 6, 2000, 1 << 17, 1 << 14), (20, 6, 3, 40, 16), (12, 12, 5, 100, 7), (100, 24, 4, 500, 100)])
def test_random_documents(spark, monkeypatch, size, gram, hot, slice_, batch):
    monkeypatch.setattr(op, "SLICE_STRINGS", slice_)
    monkeypatch.setattr(op, "BATCH_STRINGS", batch)
    monkeypatch.setattr(op, "CHUNK_BYTES", 300)
    rng = random.Random(size + hot)
    part = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(1, 3 * size))) for _ in range(12)]
    part += ["=" * 3 * size, "\0" * 2 * size, "ab" * 2 * size]
    docs = [(i, "".join(rng.choice([rng.choice(part), str(rng.random())]) for _ in range(rng.randint(0, 8)))) for i in range(70)]
    docs += [(100 + i, docs[i][1]) for i in range(0, 20, 2)] + [(200, None), (201, ""), (202, "x" * (size - 1)), (203, "x" * size), (204, "x" * 5000), (205, "".join(rng.choice("xyz") for _ in range(9000)))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int").repartition(6)
    want = plain(docs, size)
    monkeypatch.setattr(op, "HOT_RUNS", hot)
    found = op.repeated_spans(df, size, gram, hot).collect()
    got = {i: (op._cut((t or "").encode(), next((r.spans for r in found if r.doc_id == i), None))) for i, t in docs}
    assert {i: (len((t or "").encode()), got[i][1], got[i][2], got[i][0]) for i, t in docs} == want
    assert sorted(map(tuple, op.dedup_report(df, size, gram).collect())) == rows(want)
    out = op.dedup(df, size, gram)
    assert out.columns == df.columns
    assert {r.doc_id: r.text or "" for r in out.collect()} == {i: k.decode("utf-8", "replace") for i, (*_, k) in want.items()}


def test_repeated_rows_and_nulls(spark):
    t = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (6, "0123456789abcdef"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r for r in op.dedup_report(df, 20, 8).collect()}
    assert op.dedup_report(df, 20, 8).count() == 5
    assert got[(5, 56)].n_removed == 20 and got[(5, 56)].n_spans == 1      # the period repeats within the text
    assert got[(None, 56)].n_removed == 56 and got[(None, 0)].n_removed == 0 and got[(6, 16)].n_removed == 0
    assert op.dedup_report(df.limit(0), 20, 8).count() == 0 and op.dedup(df.limit(0), 20, 8).count() == 0
