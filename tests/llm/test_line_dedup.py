"""Window removal against plain Python."""
import hashlib
import random

from moodframe.llm import line_dedup as op

WS = " \t\n\x0b\f\r"


def plain(docs):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: d[0]):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            k = tuple(x.strip(WS) for x in lines[p:p + 3])
            if not "".join(k):
                continue
            if k in seen:
                gone.update((p, p + 1, p + 2))
            seen.add(k)
        spans = sum(g - 1 not in gone for g in gone)
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((i, len(lines), len(gone), spans, hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_random_documents(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice([None, "", "one", "one\ntwo"])) for i in range(6)]
    for i in range(6, 90):
        docs.append((i, "\n".join(rng.choice(["", "a", "b ", " b", "c", "d é", "e\r", f"u{i}"]) for _ in range(rng.randint(0, 25)))))
    docs.append((200, "r1\nr2\nr3\nr4\n" * 3000))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, starts int").repartition(5)
    want = plain(docs)
    assert sorted(tuple(r) for r in op.line_report(df).collect()) == [w[:5] for w in want]
    out = op.line_dedup(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text or "" for r in out.collect()} == {w[0]: w[5] for w in want}


def test_repeated_rows_and_nulls(spark):
    text = "x\ny\nz"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (4, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in op.line_dedup(df).collect()), key=str)
    assert got == sorted([(5, text), (5, text), (None, ""), (4, None), (None, None)], key=str)
    assert op.line_report(df).count() == 5 and op.line_report(df.limit(0)).count() == 0 and op.line_dedup(df.limit(0)).count() == 0
