"""Archives read back against the pages, with a plain WARC reading beside."""
import gzip
import hashlib
import io
import random

import pytest

from moodframe.llm import warc as op


def plain(pages):
    best = {}
    for i, _, h in pages:
        p = (h or "").encode()
        if len(p) >= 1000 and i is not None:
            best[p] = max(i, best.get(p, i))
    for i, _, h in pages:
        p = (h or "").encode()
        first = best.get(p)
        revisit = first is not None and first != i
        yield i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None


def test_pages_come_back(spark, tmp_path):
    rng = random.Random(9)
    bodies = [None, "", "short", "é" * 499, "é" * 500, "\r\n\r\nWARC/1.1\r\n" * 100, "x" * 200_000, "y" * op.CHUNK, "z" * (op.CHUNK * 2)]
    pages = [(i, rng.choice([None, "http://a.b/ü ?q=1\r\nX: y", "https://c"]), rng.choice(bodies)) for i in range(80)]
    pages += [pages[7], (None, "u", bodies[4]), (None, None, "only nameless " * 100), (None, None, "only nameless " * 100)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, data string").repartition(4)
    for size in (1 << 30, 50_000):
        got = op.archive_pages(df, f"file://{tmp_path}/warc{size}", archive_bytes=size // 10)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(pages), key=str)
    names = list((tmp_path / "warc50000").glob("*.warc.gz"))
    assert len(names) >= 3
    types = sum(gzip.decompress(name.read_bytes()).count(b"\r\nWARC-Type: ") for name in names)
    assert types == len(pages)


def test_chunk_table(spark, tmp_path):
    body = "".join(chr(97 + i % 26) for i in range(3 * op.CHUNK + 5))
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string")
    rows = op.read_archives(op.write_archives(op.chunk_rows(df), folder), folder).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in rows] == [0, 1, 2, 3] and b"".join(bytes(r.data) for r in rows).decode() == body
    for k, r in enumerate(rows):
        part = body[:op.CHUNK * (k + 1)]
        assert (r.bytes_so_far, r.sha1_so_far, r.last) == (len(part), hashlib.sha1(part.encode()).hexdigest(), k == 3)


def test_no_payload_in_an_exchange(spark):
    df = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found, todo = 0, [op.chunk_rows(df)._jdf.queryExecution().executedPlan()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.initialPlan())
            continue
        if "Exchange" in node.nodeName():      # of chunks and slim rows
            found += 1
            assert "payload" not in node.output().toString() and "html" not in node.output().toString()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert found >= 2


def test_empty_and_broken(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.archive_pages(df, f"file://{tmp_path}/none").count() == 0
    row = {"page_id": 1, "url": "u", "n_bytes": 3, "sha1": hashlib.sha1(b"abc").hexdigest(), "sha256": "s", "refers_to": None}
    good = op._head(row) + b"abc\r\n\r\n"
    assert [r["data"] for r in op.records_of(io.BytesIO(good * 2), 2)] == [b"ab", b"c"] * 2
    for bad in (good[:-6], good.replace(b"abc", b"abd"), b"x" + good, good[:-4] + b"....", good + b"WARC/1.1"):
        with pytest.raises(ValueError):
            list(op.records_of(io.BytesIO(bad)))
    packed = gzip.compress(good) + gzip.compress(good * 50)
    for size in (1, 7, 1 << 16):
        assert len(list(op.records_of(op.Members(io.BytesIO(packed)), size))) == 51 * (3 if size == 1 else 1)
    with pytest.raises(ValueError):
        list(op.records_of(op.Members(io.BytesIO(packed[:-9]))))
