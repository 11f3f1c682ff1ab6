"""Quality rules with cross-document line frequency (operator 4), in native
DataFrame functions only.

Every line is normalised (lower case, white space collapsed, digit runs as 0)
and hashed; per host the documents that hold a line are counted, exact copies
of a text as one document. A line held by more than ``share`` of its host's
documents, and by at least ``min_docs``, is boilerplate, and so is one held by
``max_docs`` documents, however large the host. A document is depleted if its
other lines hold too few words; of the others, such lines are cut out. Repeated
8-word windows, symbols and repeated lines within a text are counted next to that.

What is exploded and shuffled are line hashes, never texts; counts are partial
aggregates, joins are plain equi-joins that adaptive execution can split.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, written

# FIXED: white space between words, and symbol characters.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30           # per cent of words in repeated windows


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.array_join(words_of(line), " ")), "[0-9]+", "0")


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """A hash of each run of ``size`` (a power of two) consecutive words: hashes
    of pairs, of pairs of pairs, and so on."""
    def joined(step: int):
        return lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    out, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < size:
        out = bind(out, joined(step))
        step *= 2
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    return F.slice(out, 1, n)


def covered_words(hashes: Column, size: int = WINDOW) -> Column:
    """Number of words in windows whose hash comes twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        def same(x, j, k):
            return F.coalesce(F.get(s, j + k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1))

    at = F.sort_array(F.transform(bind(pairs, starts), lambda x: x["i"]))
    # each start adds the words up to the next one, at most a window
    own = bind(at, lambda a: F.transform(a, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(a, j + 1) - x, F.lit(size)))))
    total = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x)
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, total).otherwise(F.lit(0).cast("long"))


def _features(text: Column) -> Column:
    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        bind(window_hashes(w), covered_words).alias("n_repeat_words"))
    return bind(words_of(text), of_words)


def _line_features(text: Column) -> Column:
    def of_lines(x: Column) -> Column:
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                        F.transform(x, lambda v: F.struct(F.xxhash64(normalised(v)).alias("line"), F.size(words_of(v)).alias("words"))).alias("lines"))
    return bind(lines_of(text), of_lines)


def _judged(docs: DataFrame, host: str = "source", share: float = 0.05, min_docs: int = 25, max_docs: int = 1000,
            min_left: int = 20, min_left_share: float = 0.3) -> DataFrame:
    """What ``quality`` gives, and ``removed``: the places of lines above the
    limit among the lines that hold a word (null if there are none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    base = slim.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"),
        _features(F.col("text")).alias("w"), _line_features(F.col("text")).alias("l"),
        (F.size(F.split("text", SYMBOL, -1)) - 1).cast("long").alias("n_symbols"))
    base = written(base, "quality-lines")
    lines = base.select("doc_id", "host", "text_hash", F.posexplode("l.lines").alias("at", "x")).select("doc_id", "host", "text_hash", "at", "x.line", "x.words")
    held = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") >= min_docs)
    hosts = base.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    over = held.join(hosts, "host").where((F.col("held") > share * F.col("docs")) | (F.col("held") >= max_docs)).select("host", "line")
    # repeated rows bring each of their lines once
    once = lines.join(over, ["host", "line"]).groupBy("doc_id", "host", "text_hash", "at").agg(F.max("words").alias("words"))
    removed = once.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t")).agg(F.sum("words").alias("gone"), F.collect_list("at").alias("removed"))
    out = base.join(removed, base["doc_id"].eqNullSafe(removed["d"]) & (base["host"] == removed["h"]) & (base["text_hash"] == removed["t"]), "left")
    n, gone = F.col("w.n_words"), F.coalesce("gone", F.lit(0).cast("long"))
    failed = (n < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEATED * n)
    kept = ~failed & (n - gone >= min_left) & (n - gone >= min_left_share * n)
    return out.select("doc_id", "host", "text_hash", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
                      gone.alias("n_removed_words"), failed.alias("base_failed"), kept.alias("kept"), "removed")


def quality(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_words (in lines above the limit), base_failed,
    kept; one row per row of ``docs``.

    ``base_failed``: under 20 words, or over 30 % of the words in 8-word windows
    that come twice or more. ``kept``: not base_failed, and outside lines above
    the limit there are ``min_left`` words and ``min_left_share`` of all words.
    A null text has no words; a null host counts as the host ''; rows that
    repeat doc_id and text get the same verdict and count as one document; an
    empty table gives none.
    """
    return _judged(docs, host, **limits).drop("removed")


def _cut(text: Column, removed: Column) -> Column:
    """``text`` without the lines at the places ``removed`` among those that hold a word."""
    def of(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(x) - 1)
        gone = bind(F.filter(at, lambda i: F.get(x, i).rlike(NOT_SPACE)), lambda held: F.transform(removed, lambda k: F.get(held, k)))
        return F.array_join(F.transform(F.array_except(at, gone), lambda i: F.get(x, i)), "\n")
    return bind(F.split(text, "\n", -1), of)


def _verdicts(docs: DataFrame, verdict: DataFrame, host: str) -> tuple[DataFrame, DataFrame, Column]:
    """``docs`` as one struct ``row`` (whatever its columns are called), one row
    for each document of ``verdict``, and the condition that joins them."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = verdict.select("doc_id", "host", "text_hash", "kept", "removed").dropDuplicates(["doc_id", "host", "text_hash"])
    row = F.col("row")
    key = (row["doc_id"].cast("long").eqNullSafe(one["doc_id"]) & (F.coalesce(row[host].cast("string"), F.lit("")) == one["host"])
           & (F.xxhash64(F.coalesce(row["text"].cast("string"), F.lit(""))) == one["text_hash"]))
    return rows, one, key


def good_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """``docs`` without the rejected rows; columns as they were."""
    rows, bad, key = _verdicts(docs, _judged(docs, host, **limits).where("not kept"), host)
    return rows.join(bad, key, "left_anti").select("row.*")


def cleaned_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """``docs`` without the rejected rows, and without the lines above the limit
    in the texts of the others; other columns (of any name), and texts without
    such lines, as they were."""
    rows, found, key = _verdicts(docs, _judged(docs, host, **limits).where("not kept or n_removed_words > 0"), host)
    out = rows.join(found, key, "left").where(F.coalesce(found["kept"], F.lit(True)))
    old = F.col("row")["text"]
    text = F.when(found["removed"].isNull(), old).otherwise(_cut(old.cast("string"), found["removed"]))
    return out.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
