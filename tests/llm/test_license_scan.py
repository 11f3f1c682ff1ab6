"""Phrases against a plain search, expressions against values worked by hand."""
import random
import re

import pytest

from moodframe.llm import license_scan as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text):
    w = words(text)
    places = [(i, p) for p in op.BASE_PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    own = {v for p, v in op.NOTICES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()}
    base = {op.BASE_PHRASES[p] for _, p in places}
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "word_pieces", lambda t, real=op.word_pieces: real(t, 16))
    rng = random.Random(4)
    bits = ["GNU", "general", "Public", "license", "CC-BY", "cc by", "NC", "MIT", "Apache", "lesser", "ü", "x", "-", "\n", "license,"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", ".", "_", " "][:rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "MIT License " * 5000]
    automaton = op.AhoCorasick([*op.BASE_PHRASES, *op.NOTICES, *op.TAGS])
    for t in texts:
        assert op.scan((t or "").encode(), automaton)[:6] == plain(t), t
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")
    got = op.license_scan(df)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score"]
    assert sorted(map(str, [tuple(r)[1:7] for r in got.collect()])) == sorted(map(str, map(plain, texts)))
    assert op.license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "order", "families", "score"), [
    ("MIT", ["MIT"], {"mit"}, 1.0),
    ("MIT OR Apache-2.0", ["MIT", "Apache-2.0", "OR"], {"mit", "apache"}, 1.0),
    ("mit and gpl-3.0+ or agpl-3.0", ["mit", "gpl-3.0+", "AND", "agpl-3.0", "OR"], {"mit", "gpl", "agpl"}, 0.3),
    ("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", ["MIT", "Apache-2.0", "OR", "GPL-2.0-only", "Classpath-exception-2.0", "WITH", "AND"], {"mit", "apache", "gpl"}, 0.5),
    ("MPL-2.0 is what we use", ["MPL-2.0"], {"mpl"}, 0.6),
    ("(MIT AND", ["MIT"], {"mit"}, 1.0),
    ("MIT)) OR", ["MIT"], {"mit"}, 1.0),
    ("MIT.", ["MIT"], {"mit"}, 1.0),
    ("GPL-2.0 or later", ["GPL-2.0"], {"gpl"}, 0.3),
    ("0BSD OR Zlib: both", ["0BSD", "Zlib", "OR"], {"0bsd", "zlib"}, 1.0),
    ("LicenseRef-own", ["LicenseRef-own"], {"licenseref-own"}, 0.5),
])
def test_expressions(text, order, families, score):
    assert op.postfix(op.tokens_of(text)) == order
    assert op.evaluate(text) == (families, score)
    automaton = op.AhoCorasick([*op.BASE_PHRASES, *op.NOTICES, *op.TAGS])
    got = op.scan(f"// SPDX-License-Identifier: {text}\nmore words".encode(), automaton)
    assert got[5] == ",".join(sorted(families)) and got[7] == score


def test_no_licence_behind_a_tag():
    automaton = op.AhoCorasick([*op.BASE_PHRASES, *op.NOTICES, *op.TAGS])
    assert op.evaluate("") is None and op.evaluate("OR (") is None
    assert op.scan(b"SPDX-License-Identifier:", automaton)[5:] == ("", [], 0.5)


def test_prose_gives_no_label_and_many_tags_stay_linear():
    import time
    automaton = op.AhoCorasick([*op.BASE_PHRASES, *op.NOTICES, *op.TAGS])
    for text in (b"The license expression is free text", b"license expression of the day", b"SPDX-License-Identifier: see below"):
        assert op.scan(text, automaton)[5:] == ("", [], 0.5)
    began = time.process_time()
    assert len(op.scan(b"SPDX-License-Identifier: MIT " * 30_000, automaton)[6]) == 30_000
    assert time.process_time() - began < 10
