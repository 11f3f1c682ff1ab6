"""Counts against plain Python, line frequency on a table made for it."""
import random
import re

from moodframe.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts(spark):
    rng = random.Random(3)
    vocab = ["a", "Bé", "c#", "<d>", " e", "\x1cf", "\u0085"]
    texts = [None, "", " \n\t", "word", "x " * 8, "x " * 9, "x " * 30, "p q r s t u v w " * 2]
    for _ in range(150):
        words = [rng.choice(vocab[:rng.randint(1, 7)]) for _ in range(rng.randint(0, 90))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for w in words))
    for k in range(40):
        part = " ".join(f"w{i}" for i in range(k))
        texts.append(f"{part} tail {part}\n{part}")
    df = spark.createDataFrame([(i, t, None, 3) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int").repartition(3)
    got = {r.doc_id: r for r in op.quality(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t


def test_line_frequency_per_host(spark):
    foot = "Share 2024 this PAGE with all your friends and read more of it"
    own = " ".join(f"own{i}" for i in range(30))
    rows = [(i, f"{own} {i}\n{foot} {i}", "a") for i in range(30)]                  # 30 distinct documents: above the limit
    rows += [(100 + i, f"{foot.lower()}   7\nshort {i} text " + " ".join(f"z{j}" for j in range(17)), "a") for i in range(5)]   # 17 + 3 other words
    rows += [(200 + i, f"{own} {i}\n{foot} {i}", "b") for i in range(24)]           # another host, under min_docs
    rows += [(300 + i, f"{own}\n{foot}!!", "c") for i in range(40)]                 # exact copies count once
    rows += [(0, rows[0][1], "a"), (None, None, None), (None, own, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op.quality(df, min_left=20, min_left_share=0.3)
    assert got.count() == len(rows)
    r = {(x.doc_id, x.n_words): x for x in got.collect()}
    assert r[(3, 44 + 1)].n_removed_words == 45 and not r[(3, 45)].kept      # its first line is as frequent, digits aside
    assert r[(102, 34)].n_removed_words == 14 and r[(102, 34)].kept
    assert r[(203, 45)].n_removed_words == 0 and r[(203, 45)].kept
    assert r[(310, 43)].n_removed_words == 0 and r[(310, 43)].kept
    assert not r[(None, 0)].kept and r[(None, 30)].kept
    kept = op.good_documents(df, min_left=20, min_left_share=0.3)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == [*range(100, 105), *range(200, 224), *range(300, 340)]
    assert op.quality(df.limit(0)).count() == 0 and op.good_documents(df.limit(0)).count() == 0


def test_lines_above_the_limit_are_cut(spark):
    foot = "Share 2024 this PAGE with all your friends and read more of it"
    own = ["\n".join(" ".join(f"w{chr(97 + k)}{chr(97 + j)}{chr(97 + i)}" for j in range(11)) for k in range(3)) for i in range(26)]
    rows = [(i, f" \n{foot} {i}\n{x}\n\n{foot.upper()} 5\n", "a", 7) for i, x in enumerate(own)]
    rows += [rows[0], (None, rows[1][1], "a", 8), (200, f"{own[3]}\n{foot}", None, 9), (201, f"{foot}\nshort", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(3)
    got = op.cleaned_documents(df)
    assert got.columns == df.columns
    want = [(i, f" \n{x}\n\n", "a", 7) for i, x in enumerate(own)]
    want += [want[0], (None, want[1][1], "a", 8), rows[-2]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert op.cleaned_documents(df.limit(0)).count() == 0
    import corpus_pipeline
    assert sorted(map(str, map(tuple, corpus_pipeline.quality(spark, df, "").collect()))) == sorted(map(str, want))


def test_large_host_and_clashing_columns(spark):
    foot = "Share this page with all your friends and read more of it here every day of the long year now"
    rows = [(i, f"{foot}\nnumber {'x' * (i % 7)} of {i} " + " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{j}z" for j in range(4)), "a", True, "r", 1, 2) for i in range(60)]
    rows += [(1000 + i, " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(25)), "a", None, "r", 1, 2) for i in range(340)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _kept boolean, row string, `a.b` int, removed int")
    few = {r.doc_id: r for r in op.quality(df, share=0.5).collect()}
    assert few[3].kept and few[3].n_removed_words == 0              # 15 % of a host of 400
    many = {r.doc_id: r for r in op.quality(df, share=0.5, max_docs=60).collect()}
    assert not many[3].kept and many[3].n_removed_words >= 18 and many[1003].kept
    for got in (op.good_documents(df, share=0.5, max_docs=60), op.cleaned_documents(df, share=0.5, max_docs=60)):
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows[60:], key=str)
