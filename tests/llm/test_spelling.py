"""Spelling variants against plain Python."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from moodframe.llm import spelling as sp

SCHEMA = "doc_id long, text string, lang string, word string, n int"


def brute(rows, least=6, least_n=5, drop_every=199, factor=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % drop_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= least_n}
    without, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            without[w[:i], w[i + 1:]].add(w)
            if (short := w[:i] + w[i + 1:]) in n:
                near[w].add(short)
                near[short].add(w)
    for group in without.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def found(df, **settings):
    rows = sp.variant_groups(df, **settings).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "x", 1) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("aabé") for _ in range(r.randint(5, 9))) for _ in range(150)]
    rows = [(i, " ".join(r.choices(words, weights=[1 + k % 40 for k in range(150)], k=200)).title()) for i in range(30)] + [(None, "aaaaaa " * 9), (3, None), (4, "")]
    assert found(docs(spark, rows), drop_every=7, factor=2) == brute(rows, drop_every=7, factor=2)


def test_roots_follow_chains(spark):
    rows = [(1, " ".join(w for k in range(9) for w in ["x" * 6 + "y" * k] * 2 ** (k + 3)))]      # each half as frequent as the next
    got = found(docs(spark, rows), drop_every=10**9, factor=2)
    assert got == brute(rows, drop_every=10**9, factor=2)
    assert got["xxxxxx"][:2] == ("xxxxxxy", "x" * 6 + "y" * 8)


def test_runs_of_one_letter_count_once_and_ties_go_by_code_point(spark):
    rows = [(1, "aaaaaaa " * 5 + "aaaaaa " * 50 + "zaaaaaa " * 50 + "baaaaaa " * 50)]
    got = found(docs(spark, rows), drop_every=10**9)
    assert got == brute(rows, drop_every=10**9)
    assert got["aaaaaaa"] == ("aaaaaa", "aaaaaa", 5, 3, 50)       # near by one deletion, met at seven places


def test_long_words(spark):
    base = "abcdefghij" * 30
    sizes = [sp.LONG - 2, sp.LONG - 1, sp.LONG, sp.LONG + 1, sp.LONG + 2]
    rows = [(1, " ".join([base[:s] for s in sizes] * 30 + [base[:s - 1] + "z" for s in sizes] * 5))]
    assert found(docs(spark, rows), drop_every=10**9) == brute(rows, drop_every=10**9)
    long = "ab" * 20_000
    rows = [(1, f"{long} " * 25 + f"{long[1:]} " * 5)]
    assert found(docs(spark, rows), drop_every=10**9) == {long: (None, long, 25, 1, None), long[1:]: (long, long, 5, 1, 25)}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "colour Colour COLOUR"), (1, "colour Colour COLOUR")]
    assert found(docs(spark, rows), drop_every=10**9) == {"colour": (None, "colour", 6, 0, None)}
    assert found(docs(spark, [])) == {}
    assert found(docs(spark, [(1, None)])) == {}


def test_groups_are_written(spark, tmp_path):
    rows = [(1, "spelling " * 30 + "speling " * 5)]
    path = sp.write_groups(docs(spark, rows), f"file://{tmp_path}/groups", drop_every=10**9)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("speling", "spelling")]
