"""Sources (S1-S11, S13, S14): CSV/JSON/text/Parquet readers and nested
response flattening. Every reader takes a path (a folder of landed files)
and returns a DataFrame with an explicit schema; only the delimiter sniff
reads one line on the driver."""
from __future__ import annotations

import os
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import dataset as ds
from ..operators import sampling as sm

TEXT_LABEL = "text STRING, label STRING"
SNIFF = [",", ";", "\t", "|"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    counts = {d: line.count(d) for d in SNIFF}
    best = max(SNIFF, key=lambda d: (counts[d], -SNIFF.index(d)))
    return best if counts[best] > 0 else ","


def read_labeled(spark: SparkSession, path: str, sep: str | None = None, multiline: bool = False) -> DataFrame:
    """S1 strict loader: first two columns by position -> (text, label),
    header skipped, validated (P1); delimiter sniffed when not given.
    ``multiline`` for quoted newlines: each file is then one task."""
    sep = sep or sniff_delimiter(spark, path)
    raw = (spark.read.option("header", True).option("sep", sep).option("multiLine", multiline)
           .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    if len(raw.columns) < 2:
        return spark.createDataFrame([], TEXT_LABEL)
    two = raw.select(F.col(raw.columns[0]).alias("text"), F.col(raw.columns[1]).alias("label"))
    return ds.validate(two)


def read_dataset(spark: SparkSession, path: str, schema: str = TEXT_LABEL, multiline: bool = False) -> DataFrame:
    """S2 plain CSV with header; ``multiline`` for quoted newlines (a task a file)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", multiline)
            .option("escape", '"').csv(path))


def read_processed(spark: SparkSession, path: str, language: str) -> DataFrame:
    """S3 processed data partitioned by lang= (partition pruning)."""
    return spark.read.parquet(path).filter(F.col("lang") == language)


def read_manual(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """S4 manual labels; a missing folder gives an empty (text, label)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], TEXT_LABEL)
    return read_dataset(spark, path, multiline=multiline)


def collect_manual(df: DataFrame, quotas: dict, key: str = "row_id") -> DataFrame:
    """Label -> sentiment when sentiment is missing, per-sentiment
    quotas (B5), projection (text, sentiment)."""
    if "sentiment" not in df.columns and "label" in df.columns:
        df = df.withColumnRenamed("label", "sentiment")
    df = df.withColumn("sentiment", F.col("sentiment").cast("int"))
    return sm.quota_sample(df, quotas, label_col="sentiment", key_col=key).select(key, "text", "sentiment")


def reviews_to_rows(df: DataFrame, quotas: dict | None = None, key: str = "row_id") -> DataFrame:
    """S6 app-store reviews (content, score) -> (text, sentiment by P9)."""
    out = df.select(key, F.col("content").alias("text"), ds.rating_to_sentiment("score").alias("sentiment"))
    return sm.quota_sample(out, quotas, label_col="sentiment", key_col=key) if quotas else out


MARKET_SCHEMA = T.StructType([T.StructField("data", T.StructType([T.StructField("ratings", T.ArrayType(
    T.StructType([T.StructField("rating_star", T.IntegerType()), T.StructField("comment", T.StringType())])))]))])

THREAD_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField("message", T.StringType())])))])

POST_SCHEMA = T.StructType([T.StructField("message", T.StringType()), T.StructField("comments", T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([T.StructField("message", T.StringType()),
                                                    T.StructField("id", T.StringType())])))]))])


def flatten_marketplace(df: DataFrame, json_col: str, key: str, source: str = "marketplace") -> DataFrame:
    """ratings[] flattened; blank comments dropped; a missing star counts
    as 0 (negative)."""
    r = df.select(key, F.explode_outer(F.from_json(json_col, MARKET_SCHEMA).getField("data").getField("ratings")).alias("r"))
    r = r.select(key, F.col("r.comment").alias("text"), F.coalesce(F.col("r.rating_star"), F.lit(0)).alias("star"))
    r = r.filter(F.col("text").isNotNull() & (tx.py_strip(F.col("text")) != ""))
    return r.select(key, "text", ds.rating_to_sentiment("star").alias("label"), F.lit(source).alias("source"))


def flatten_thread(df: DataFrame, json_col: str, key: str, source: str = "thread") -> DataFrame:
    """data[] flattened; missing message -> ''; label null."""
    r = df.select(key, F.posexplode(F.from_json(json_col, THREAD_SCHEMA).getField("data")).alias("pos", "m"))
    return r.select(key, "pos", F.coalesce(F.col("m.message"), F.lit("")).alias("text"),
                    F.lit(None).cast("int").alias("label"), F.lit(source).alias("source"))


def post_texts(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """S8 post form: [post.message] ++ comments.data[].message."""
    p = F.from_json(json_col, POST_SCHEMA)
    arr = F.concat(F.array(p.getField("message")),
                   F.coalesce(F.transform(p.getField("comments").getField("data"), lambda c: c.getField("message")),
                              F.array().cast("array<string>")))
    return df.select(key, F.posexplode(arr).alias("pos", "text"))


def union_files(spark: SparkSession, paths: list[str], multiline: bool = False) -> DataFrame:
    """CSVs unioned by column name, missing columns null."""
    out = None
    for p in paths:
        d = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(p)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word per line -> distinct trimmed words; missing -> empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "word STRING")
    w = spark.read.text(path).select(tx.py_strip(F.col("value")).alias("word"))
    return w.filter(F.col("word") != "").distinct()


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """S11: 'word,syn1,syn2,...' lines -> (word, synonyms)."""
    parts = spark.read.text(path).select(F.split(F.col("value"), ",").alias("p"))
    parts = parts.select(F.transform("p", lambda x: tx.py_strip(x)).alias("p"))
    return parts.filter(F.size("p") >= 2).select(F.col("p")[0].alias("word"), F.slice("p", 2, F.size("p")).alias("synonyms"))


def metric_snapshot_rows(snap: DataFrame, *keys: str) -> DataFrame:
    """Parallel arrays of request times and latencies -> one row each."""
    z = snap.select(*keys, F.posexplode(F.arrays_zip(F.col("requests"), F.col("response_times"))).alias("i", "r"))
    return z.select(*keys, "i", F.col("r.requests").alias("ts"), F.col("r.response_times").alias("response_time"))


P_BLOCK = r"(?s)<p>(.*?)</p>"
H1 = r"(?s)<h1>(.*?)</h1>"


def extract_comments(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Comment blocks of a page (paragraph elements), their text with
    tags removed and trimmed, the author from the heading; only rows with
    both text and author."""
    author = tx.py_strip(tx.strip_tags(F.regexp_extract(F.col(html), H1, 1)))
    blocks = pages.select(key, author.alias("author"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(P_BLOCK), 1)).alias("pos", "block"))
    c = blocks.select(key, "pos", "author", tx.py_strip(tx.strip_tags(F.col("block"))).alias("text"))
    return c.filter((F.col("text") != "") & (F.col("author") != ""))


# ---- S14: the comment tree of a page ---------------------------------------------

#: elements that have no end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
COMMENT_TREE = ("pos int, comment_id string, parent_id string, author string, profile string, posted string, text string, "
                "reactions_label string, is_reply boolean, badge boolean")
_TREE_FIELDS = [f.split()[0] for f in COMMENT_TREE.split(", ")]


class _CommentScanner(HTMLParser):
    """One pass over a page with a stack of open elements. A comment is an element
    with role="article"; what lies in a comment inside it belongs to that one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None, str | None, bool]] = []     # tag, comment that starts here, field that its text fills, indented
        self.held = Counter()                                               # open elements by tag, so that a stray end tag costs nothing
        self.comments: list[dict] = []
        self.inside: list[dict] = []                                        # open comments, innermost last
        self.filling: list[tuple[dict, str]] = []
        self.indents = 0

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        label, href, comment, field = at.get("aria-label", ""), at.get("href", ""), None, None
        if at.get("role") == "article":
            comment = {"pos": len(self.comments), "parent": self.inside[-1] if self.inside else None, "id": None, "linked": None, "author": [], "profile": None, "posted": [],
                       "text": [], "label": None, "reply": bool(self.inside) or self.indents > 0 or "Reply" in label or "Trả lời" in label, "badge": []}
            self.comments.append(comment)
            self.inside.append(comment)
        elif self.inside:
            own = self.inside[-1]
            if tag == "a" and "comment_id=" in href and own["id"] is None:
                reply, top = (re.search(rf"(?:^|[?&]){k}=([0-9_]+)", href) for k in ("reply_comment_id", "comment_id"))
                own["id"], own["linked"] = (reply or top)[1] if reply or top else None, top[1] if reply and top else None
                own["reply"] |= reply is not None
                field = "posted"
            elif tag == "a" and at.get("role") == "link" and at.get("tabindex") == "0" and own["profile"] is None:
                own["profile"], field = href, "author"
            elif tag == "div" and at.get("role") == "link":
                field = "badge"
            elif at.get("dir") == "auto":
                field = "text"
            if own["label"] is None and "reaction" in label:
                own["label"] = label
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        indented = bool(re.search(r"(?:margin|padding)-left", at.get("style", "")))
        self.indents += indented
        self.held[tag] += 1
        self.open.append((tag, comment, field, indented))
        if field:
            self.filling.append((self.inside[-1], field))

    def handle_endtag(self, tag):
        if not self.held[tag]:
            return
        while True:
            name, comment, field, indented = self.open.pop()
            self.held[name] -= 1
            self.indents -= indented
            if field:
                self.filling.pop()
            if comment is not None:
                self.inside.pop()
            if name == tag:
                return

    def handle_data(self, data):
        if self.filling and self.inside and self.filling[-1][0] is self.inside[-1]:
            self.filling[-1][0][self.filling[-1][1]].append(data)

    def rows(self):
        for c in self.comments:
            parent = (c["parent"]["id"] if c["parent"] else None) or c["linked"]
            yield (c["pos"], c["id"], parent if c["reply"] else None, "".join(c["author"]), c["profile"], "".join(c["posted"]) or None, "".join(c["text"]),
                   c["label"], c["reply"], "Top contributor" in "".join(c["badge"]))


def _scanned(batches):
    for batch in batches:
        keys, rows = [], []
        for i, page in enumerate(batch.column(1)):
            scanner = _CommentScanner()
            scanner.feed(page.as_py() or "")
            scanner.close()
            for row in scanner.rows():
                keys.append(i)
                rows.append(row)
        columns = list(zip(*rows, strict=True)) or [()] * len(_TREE_FIELDS)
        kinds = [pa.int32(), *[pa.string()] * 7, pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_key", *_TREE_FIELDS])


def comment_tree(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every comment element of a page with its id, parent's id,
    author, profile, time as written, text, reactions, reply flag, badge and
    language; only comments that have text and author. ``pos`` counts the
    comment elements of the page from 0.

    A reply is a comment inside another, in an indented element, labelled as
    one, or linked by reply_comment_id; its parent is the comment around it, or
    the one its link names. A null page has no comments; unclosed elements end
    with the element around them."""
    kind = T.StructType([T.StructField("_key", pages.schema[key].dataType), *T.StructType.fromDDL(COMMENT_TREE).fields])
    rows = pages.select(F.col(key).alias("_key"), F.col(html).cast("string").alias("html")).mapInArrow(_scanned, kind)
    rows = rows.withColumn("author", tx.py_strip(F.col("author"))).withColumn("text", tx.py_strip(F.col("text"))).withColumn("posted", tx.py_strip(F.col("posted")))
    rows = rows.filter((F.col("text") != "") & (F.col("author") != ""))
    return rows.select(F.col("_key").alias(key), *[c for c in _TREE_FIELDS if c != "reactions_label"],
                       tx.reaction_counts(F.coalesce("reactions_label", F.lit(""))).alias("reactions"), tx.detect_language(F.col("text")).alias("language"))
