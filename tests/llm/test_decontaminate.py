"""Suffix-array search against a plain window search."""
import hashlib
import random
import re

from moodframe.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(window, len(v))
        wins = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        for p in range(len(w) - size + 1):
            if tuple(w[p:p + size]) in wins:
                hit.update(range(p, p + size))
                found.add(str(item))
    longest = max((n for _, t in items for v in [words(t)] for i in range(len(v)) for n in range(min(window, len(v)), len(v) - i + 1)
                   if any(w[p:p + n] == v[i:i + n] for p in range(len(w) - n + 1))), default=0) if hit else 0
    return len(w), len(hit), sorted(found), longest


def made(rng, most):
    return " ".join(rng.choice(["a", "b", "C", "é", "d-e", "", "x" * 70, "x" * 69 + "y"]) for _ in range(rng.randint(0, most)))


def test_random_texts(spark):
    rng = random.Random(11)
    for window in (1, 3, 5):
        docs = [(i, made(rng, 40)) for i in range(60)] + [(7, "a b c"), (7, "a b c"), (None, None), (99, "")]
        items = [(i, made(rng, 9)) for i in range(5)] + [(4, "a é"), (8, None), (9, "..")]
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        b = spark.createDataFrame(items, "item_id long, text string")
        want = sorted((str(i), *brute(t, items, window)[:2], len(brute(t, items, window)[2]),
                       hashlib.sha256(",".join(brute(t, items, window)[2]).encode()).hexdigest(), brute(t, items, window)[3]) for i, t in docs)
        for block in (1 << 20, 70):      # one block, and many
            found = op.overlaps(d, b, window, block_bytes=block)
            got = sorted((str(r.doc_id), r.found.n_words, sum(s.past - s.first for s in r.found.spans), len(r.found.items),
                          hashlib.sha256(",".join(r.found.items).encode()).hexdigest(), r.found.longest_match) for r in found.collect())
            assert got == want


def test_share_rule_and_kept_rows(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = [(1, item + " z" * 247, "x"), (2, item + " z" * 248, "x"), (3, "clean", None), (4, None, "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, found string")
    b = spark.createDataFrame([(5, item, 1)], "item_id long, text string, doc_id long")
    got = {r.doc_id: r for r in op.contamination(d, b).collect()}
    assert got[1].contaminated and got[1].n_hit == 13 and got[1].longest_match == 13 and got[1].longest_item == "5" and got[1].longest_at == 0
    assert not got[2].contaminated and got[2].n_hit == 13
    assert got[4].n_words == 0 and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = op.decontaminate(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4}
    assert op.decontaminate(d, b.limit(0)).count() == 4 and op.contamination(d.limit(0), b).count() == 0


def test_longest_prefixes_against_every_pair():
    import numpy as np
    rng = random.Random(5)
    for _ in range(60):
        def runs(n):
            return np.array([c for _ in range(n) for c in [rng.randint(1, 2) for _ in range(rng.randint(1, 12))] + [0]], dtype=np.int64)
        text, items = runs(rng.randint(1, 6)), runs(rng.randint(1, 6))
        place, suffix = np.flatnonzero(text), np.flatnonzero(items)

        def common(p, q):
            n = 0
            while text[p + n] and text[p + n] == items[q + n]:
                n += 1
            return n
        depth, lo, hi, order = op.longest(text, place, items, suffix)
        for i, p in enumerate(place):
            sizes = [common(p, q) for q in suffix]
            assert depth[i] == max(sizes)
            if depth[i]:
                assert sorted(order[lo[i]:hi[i]]) == [k for k, n in enumerate(sizes) if n == depth[i]]


def test_repetitive_texts_stay_small_and_long_texts_whole():
    import tracemalloc
    block = op.Block([("1", b"ab " * 800), ("2", b"ab cd " * 9), ("3", b"ef gh")], 13)
    tracemalloc.start()
    rows = op._rows([b"ab " * 8000, b"xy " + b"ab cd " * 9 + b"ab " * 30, b"zz " * 200_000 + b"ef gh"], block, None)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert rows[0][0] == 8000 and rows[0][1] == [{"first": 0, "past": 8000}] and rows[0][2:] == (["1"], 800, "1", 0)
    assert rows[1][2:] == (["1", "2"], 30, "1", 19)
    assert rows[2] == (200_002, [{"first": 200_000, "past": 200_002}], ["3"], 2, "3", 200_000)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    import numpy as np
    weak = np.tile(np.arange(256, dtype=np.uint64), 64)     # a word's hash is the sum of its bytes
    monkeypatch.setattr(op, "hash_table", lambda seed, strong=op.hash_table: weak if seed == 0 else strong(seed))
    block = op.Block([("1", b"ab cd ef")], 3)
    assert block.seed == 0
    assert [len(r[1]) for r in op._rows([b"ab cd ef", b"ba cd ef"], block, None)] == [1, 0]
    block = op.Block([("1", b"ab ba ef")], 3)
    assert block.seed == 1
    assert [len(r[1]) for r in op._rows([b"ab ba ef", b"ba ab ef"], block, None)] == [1, 0]
