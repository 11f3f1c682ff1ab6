"""Line deduplication over overlapping three-line windows (operator 9), in
native DataFrame functions only.

Every run of three consecutive lines is hashed to 128 bits. The first
occurrence of a window, by (doc_id, place), stays; the lines that later ones
cover are removed, overlapping windows merging into one span. A window is
judged on the input, not on what is left.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, written

WINDOW = 3
# FIXED: the white space that is cut from a line's ends before it is compared.
_ENDS = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _windows(lines: Column, size: int) -> Column:
    """(first line, hash, hash) of each window that isn't blank throughout."""
    def of(x: Column) -> Column:
        def window(i: Column) -> Column:
            parts = [F.get(x, i + k) for k in range(size)]
            return F.struct(i.alias("at"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(9), *reversed(parts)).alias("b"),
                            (F.concat(*parts) == "").alias("blank"))
        starts = F.when(F.size(x) >= size, F.sequence(F.lit(0), F.size(x) - size)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, window), lambda w: ~w["blank"])
    return bind(F.transform(lines, lambda v: F.trim(v, F.lit(_ENDS))), of)


def repeated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_hash and ``starts``, the first lines of windows that occur
    earlier, for every document that has one. Documents order by doc_id (null
    last), then by a hash of the text; rows that repeat both are one document."""
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("text_hash"), F.col("at"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
                       _windows(_lines(F.col("text")), size).alias("w"))
    seen = written(slim.select("doc_id", "text_hash", F.explode("w").alias("w")).select("doc_id", "text_hash", "w.at", "w.a", "w.b"), "line-windows")
    first = seen.groupBy("a", "b").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first <> last").select("a", "b", "first")
    later = seen.join(first, ["a", "b"]).where(key != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("starts"))


def _kept(docs: DataFrame, size: int) -> DataFrame:
    """``row`` (all columns of ``docs``), its lines, the covered line numbers in
    order, and the lines that stay."""
    found = repeated_lines(docs, size)
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "starts")
    all_ = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    joined = all_.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_t")), "left")
    lines = F.split(text, "\n", -1)
    gone = F.sort_array(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1))))))
    return joined.select("row", F.size(lines).alias("n"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"), lines.alias("lines"))


def _text(lines: Column, gone: Column) -> Column:
    def of(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")
    return bind(lines, of)


def line_report(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans (maximal removed runs) and
    kept_sha256 (of the lines that stay, joined by newlines); one row per row.

    Lines are what newlines separate, so a null or empty text is one empty line;
    they are compared without white space at their ends. Windows of blank lines
    don't count. Texts of fewer than three lines stay as they are.
    """
    def spans(g: Column) -> Column:
        return F.size(F.filter(g, lambda x, i: F.coalesce(F.get(g, i - 1) != x - 1, F.lit(True))))
    kept = _kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size)
    return kept.select(F.col("row.doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
                       bind(F.col("gone"), spans).cast("long").alias("n_spans"), F.sha2(_text(F.col("lines"), F.col("gone")), 256).alias("kept_sha256"))


def line_dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows removed from its texts; rows and columns
    stay as they were, a text without repeats (or null) is untouched."""
    kept = _kept(docs, size)
    text = F.when(F.size("gone") > 0, _text(F.col("lines"), F.col("gone"))).otherwise(F.col("row.text"))
    return kept.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(ls) - 2)) AS p, ls FROM l WHERE len(ls) >= 3),
k AS (SELECT doc_id, p, [trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR x IN ls[p:p + 2]] AS k FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM k WHERE array_to_string(k, '') <> ''),
g AS (SELECT DISTINCT doc_id, p + o AS i FROM r, (VALUES (0), (1), (2)) v(o) WHERE n > 1),
x AS (SELECT doc_id, list(i) AS gone, count(*) AS n, sum(CASE WHEN prev IS DISTINCT FROM i - 1 THEN 1 ELSE 0 END) AS spans
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM g) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(coalesce(gone, []), i)], chr(10))) AS kept_sha256
FROM l LEFT JOIN x USING (doc_id)
"""
