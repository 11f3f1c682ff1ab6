"""Readers, sinks and augmentation determinism."""
import os

from pyspark.sql import functions as F

from moodframe.operators import augment as ag
from moodframe.session import scratch_path
from moodframe.sources import readers as rd
from moodframe.sources import sinks as sk


def test_strict_loader_sniffs_and_validates(spark, tmp_path):
    path = str(tmp_path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write('review;score;extra\n"good; really";2;x\n"bad";1.7;y\n"meh";positive;z\n"x";5;w\n')
    got = sorted((r.text, r.label) for r in rd.read_labeled(spark, path).collect())
    assert got == [("bad", 1), ("good; really", 2)]


def test_missing_manual_source_is_empty(spark):
    assert rd.read_manual(spark, scratch_path(spark, "nope")).count() == 0


def test_nested_json_flatten(spark):
    j = '{"data":{"ratings":[{"rating_star":5,"comment":"great"},{"rating_star":null,"comment":"meh"},{"rating_star":4,"comment":"  "}]}}'
    df = spark.createDataFrame([(1, j)], "id INT, json STRING")
    got = sorted((r.text, r.label) for r in rd.flatten_marketplace(df, "json", "id").collect())
    assert got == [("great", 2), ("meh", 0)]
    post = '{"message":"post","comments":{"data":[{"message":"c1","id":"1"},{"message":"c2","id":"2"}]}}'
    p = spark.createDataFrame([(1, post)], "id INT, json STRING")
    assert [r.text for r in rd.post_texts(p, "json", "id").orderBy("pos").collect()] == ["post", "c1", "c2"]


def test_ingest_skips_empty(spark):
    df = spark.createDataFrame([], "x INT")
    assert sk.write_ingest(df, scratch_path(spark, "t-k2"), "s", "t") is False


def test_augmentation_partition_invariant(spark):
    rows = [(i, f"the good word {i} and the rest of it") for i in range(40)]
    outs = []
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(parts)
        a = ag.augment_rows(df, "doc_id", "text", n_per_sample=5)
        outs.append(sorted((r.doc_id, r.variant, r.aug_text) for r in a.collect()))
    assert outs[0] == outs[1]
    assert len(outs[0]) == 40 * 6


def test_comment_tree(spark):
    def comment(name, text, link, inner="", more=""):
        return (f'<div role="article" aria-label="{more}"><div><a role="link" tabindex="0" href="/{name}"><span> {name} </span></a></div>'
                f'<div dir="auto">{text}</div><a href="{link}">2h</a>{inner}</div>')
    deep = comment("cy", "third &lt;b&gt;", "?x=1&amp;comment_id=11&amp;reply_comment_id=13")
    page = ("<html><!-- <div role='article'> --><script>var a = '<div role=\"article\">';</script><div role='link'>Top contributor</div>"
            + comment("ann", "first<br>line <b>two</b>", "/p?comment_id=10", '<i aria-label="2 Like, 1 Love reactions"></i></p></em><ul><li>'
                      + comment("bob", "second", "/p?comment_id=11", "<ul><li>" + deep + "</ul>") + "</ul><div role='link'>Top contributor</div>")
            + '<div style="padding-left: 4px">' + comment("dee", "xin chào", "/p?comment_id=21&reply_comment_id=22") + "</div>"
            + comment("eve", " ", "/p?comment_id=30") + comment("", "nobody", "/p?comment_id=31") + comment("fay", "alone", "/p", more="Reply by fay") + "<div role='article'><div dir='auto'>open")
    df = spark.createDataFrame([(1, page, "c"), (2, None, "c"), (3, "", "c"), (4, "<p>no comment</p>", "c")], "page_id long, html string, comment_id string")
    got = [(r.page_id, r.pos, r.comment_id, r.parent_id, r.author, r.profile, r.posted, r.text, r.reactions.total, r.is_reply, r.badge, r.language) for r in rd.comment_tree(df).orderBy("pos").collect()]
    assert got == [(1, 0, "10", None, "ann", "/ann", "2h", "first\nline two", 3, False, True, "en"),
                   (1, 1, "11", "10", "bob", "/bob", "2h", "second", 0, True, False, "en"),
                   (1, 2, "13", "11", "cy", "/cy", "2h", "third <b>", 0, True, False, "en"),
                   (1, 3, "22", "21", "dee", "/dee", "2h", "xin chào", 0, True, False, got[3][11]),
                   (1, 6, None, None, "fay", "/fay", None, "alone", 0, True, False, "en")]
    assert rd.comment_tree(df.limit(0)).count() == 0


def test_comment_tree_of_a_broken_page_is_linear(spark):
    import time
    began = time.process_time()
    scanner = rd._CommentScanner()
    scanner.feed("<b>" * 100_000 + "</i>" * 100_000 + "<div role='article'>" * 1000 + "</b>")
    assert len(scanner.comments) == 1000 and len(scanner.open) == 99_999 and time.process_time() - began < 20
