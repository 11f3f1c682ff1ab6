"""The automaton against the tokenizers library and against plain merging."""
import hashlib
import json
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from moodframe.llm import bpe_automaton as op  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def mine():
    with open(PATH, encoding="utf-8") as f:
        return op.Tokenizer(f.read())


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize("alphabet", ["ab ", "aA \n'sltre", "éü中文😀 \u0085​\x1c᠎\xa0", "0123456789.,-=_ ", "՘a \U0003d001"])
def test_same_ids_as_the_library(mine, theirs, alphabet):
    rng = random.Random(5)
    for _ in range(800):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        s = rng.choice([s, s + "<|endoftext|>", s + " <|endoftext|>x"])
        ids = mine.encode(s)
        assert ids == theirs.encode(s, add_special_tokens=False).ids
        assert mine.decode(ids) == s


def test_random_merge_lists_against_plain_merging():
    rng = random.Random(7)
    for _ in range(60):
        vocab, merges, known = {c: i for i, c in enumerate("abc")}, [], ["a", "b", "c"]
        for _ in range(rng.randint(1, 14)):
            u, v = rng.choice(known), rng.choice(known)
            if u + v in vocab:
                continue
            vocab[u + v] = len(vocab)
            merges.append((u, v))
            known.append(u + v)
        rank = {m: i for i, m in enumerate(merges)}
        dfa = op.MergeAutomaton(vocab, merges)
        assert dfa.states <= len(merges) + 1
        for _ in range(60):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            seq = list(w)
            while pairs := [(rank[p], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)) if p in rank]:
                _, i = min(pairs)
                seq[i:i + 2] = [seq[i] + seq[i + 1]]
            assert dfa.encode(w.encode()) == [vocab[t] for t in seq], (merges, w)


def test_rows_nulls_long_texts_clashing_columns(spark, theirs):
    long = "word and more " * 400_000
    rows = [(1, "Hello world", 9), (1, "Hello world", 9), (None, None, 1), (3, "", 2), (4, long, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids long")
    got = {(r.doc_id, r.n_tokens): r for r in op.token_digests(df, PATH).collect()}
    ids = theirs.encode(long, add_special_tokens=False).ids
    assert got[(4, len(ids))].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[(4, len(ids))].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[(3, 0)].ids_sha256 == got[(None, 0)].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert op.token_digests(df, PATH).count() == 5 and op.token_digests(df.limit(0), PATH).count() == 0
    tokens = op.encode(df.limit(4), PATH)
    assert tokens.columns == ["doc_id", "text", "token_ids"]
    back = op.decode(tokens.drop("text"), PATH).collect()
    assert sorted(r.text for r in back) == ["", "", "Hello world", "Hello world"]


def test_unfit_files_are_refused(mine):
    with pytest.raises(ValueError):
        op.MergeAutomaton({"a": 0, "b": 1, "ab": 2}, [("a", "b"), ("a", "b")])
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        op.Tokenizer(json.dumps(spec))
