"""Spelling variant grouping by permuterm rotations (operator 11).

Words are counted over whole texts. A word gets the terminator ``$`` and all
its rotations; for a word a·c·b the rotation that starts behind c is b$a·c, so
words that differ from it in c alone share the prefix b$a, and the word a·b,
which lacks c, has b$a as a whole rotation. A row per rotation and per rotation
without its last character goes to the partition of that prefix, is sorted
there, and the prefix's range is scanned: it holds at most one word without the
skipped character and one per character of the alphabet, however often words
occur. A range gives each of its words one row (near words, best of them),
never pairs.

Defined results: a null text has no words, a null doc_id hashes as the empty
string, a repeated row counts each time, an empty table gives no rows, further
columns are ignored. A word of any length takes part: a rotation of more than
LONG code points travels as its polynomial hash modulo 2^127 - 1, so a word's
rows grow with its length and not with the square of it.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written

#: FIXED: letters are A-Z, a-z and U+00C0 to U+00FF
_LETTERS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
TERMINATOR = "$"
LONG = 256          # code points of a rotation that travels as itself
_PRIME, _BASE = (1 << 127) - 1, 0x1B873593CC9E2D51E6546B64
FLUSH_WORDS = 300_000
OUT_ROWS = 100_000
# kinds of a row: the word itself, itself (its row that is always kept), a character skipped, one skipped that repeats the one before it
_WHOLE, _OWN, _GAP, _TWIN = 0, 1, 2, 3


def _counted(drop_every: int, least: int):
    """Counts of the words of whole texts, summed up to FLUSH_WORDS words at a
    time. In Latin-1 every letter is one byte and what can't be written is no
    letter, so one table lower-cases and splits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if (text := text.as_py()) is None:
                    continue
                key = zlib.crc32(f"{'' if (doc := doc.as_py()) is None else doc}:".encode())
                for w, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(w) < least:
                        continue
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), key)
                    if h % drop_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < least:
                            continue
                    total[w] += n
                if len(total) >= FLUSH_WORDS:
                    yield out()
                    total.clear()
        if total:
            yield out()
    return run


def word_counts(docs: DataFrame, least: int = 6, least_n: int = 5, drop_every: int = 199) -> DataFrame:
    """Words of ``least`` code points or more that occur ``least_n`` times or
    more over all texts: (word, n)."""
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text"))
    return rows.mapInArrow(_counted(drop_every, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _long_keys(word: str) -> tuple[list[str], list[str]]:
    """Hashes of the rotations of ``word`` and of those without their last
    character, each from two prefix hashes."""
    size = len(word)
    prefix, power = [0], [1]
    for c in word:
        prefix.append((prefix[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)

    def key(skip: int, end: int) -> str:
        """The rotation word[skip:] $ word[:end]."""
        tail = prefix[size] - prefix[skip] * power[size - skip]
        return f"#{size - skip + 1 + end}:{((tail * _BASE + ord(TERMINATOR)) * power[end] + prefix[end]) % _PRIME:x}"
    return [key(i, i) for i in range(size + 1)], [key(i + 1, i) for i in range(size)]


def _keys(word: str) -> tuple[list[str], list[str]]:
    """The rotations of ``word`` + terminator, and those that end in a letter
    without that letter; both by the place where the word is cut."""
    size, ring = len(word), f"{word}{TERMINATOR}{word}"
    if size < LONG:
        return [ring[i:i + size + 1] for i in range(size + 1)], [ring[i + 1:i + 1 + size] for i in range(size)]
    whole, gaps = _long_keys(word)   # hashed or not goes by a key's own length, so that words one apart agree
    return whole, gaps if size > LONG else [ring[i + 1:i + 1 + size] for i in range(size)]


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[str] = []
    kinds: list[int] = []
    ns: list[int] = []
    ids: list[int] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int8()), pa.array(ns, pa.int64()), pa.array(ids, pa.int64())], ["key", "kind", "n", "id"])
    for batch in batches:
        for i, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole, gaps = _keys(word)
            keys += whole + gaps
            kinds += [_WHOLE] * len(word) + [_OWN] + [_TWIN if j and word[j - 1] == c else _GAP for j, c in enumerate(word)]
            ns += [n] * (len(whole) + len(gaps))
            ids += [i] * (len(whole) + len(gaps))
            if len(keys) >= OUT_ROWS:
                yield out()
                keys, kinds, ns, ids = [], [], [], []
    if keys:
        yield out()


def near_words(words: DataFrame) -> DataFrame:
    """For (id, word, n), ids in the order of the words: (id, n, n_near,
    best_n, best_id), the near word of largest n, ties by the smaller id.

    An insertion inside a run of equal characters is met at each of them; it is
    counted at the first alone (the other rows are twins)."""
    rows = words.select("id", "word", "n").mapInArrow(_rotations, "key string, kind byte, n long, id long")
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.col("n").desc(), "id")
    kind = F.col("kind")
    seen = rows.select("*", F.count(F.lit(1)).over(group).alias("size"), F.max(kind <= _OWN).over(group).alias("whole"), F.max(kind == _TWIN).over(group).alias("twin"),
                       F.row_number().over(ranked).alias("place"), F.first(F.struct("n", "id")).over(ranked).alias("first"), F.lead(F.struct("n", "id")).over(ranked).alias("next"))
    best = F.when(F.col("place") > 1, F.col("first")).otherwise(F.col("next"))
    twice = F.when(kind <= _OWN, F.col("twin")).when(kind == _TWIN, F.col("whole")).otherwise(F.lit(False))
    met = seen.filter((F.col("size") > 1) | (kind == _OWN)).select(
        "id", "n", (F.col("size") - 1 - twice.cast("long")).alias("near"), F.when(best.isNotNull(), F.struct((-best["n"]).alias("n"), best["id"].alias("id"))).alias("best"))
    return met.groupBy("id").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best")).select(
        "id", "n", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("best_id"))


def variant_groups(docs: DataFrame, least: int = 6, least_n: int = 5, drop_every: int = 199, factor: int = 5) -> DataFrame:
    """Every word with its form (the near word of largest n, if that is
    ``factor`` times the word's n or more), the root its forms lead to, n,
    n_near and form_n.

    Words are numbered in code-point order by a range sort, so that later steps
    carry numbers. A form is ``factor`` times as frequent as its word, so a
    chain has at most log(largest n / least_n) / log(factor) links and pointer
    doubling ends after the logarithm of that."""
    counts = written(word_counts(docs, least, least_n, drop_every), "spelling-counts")
    words = written(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    found = written(near_words(words), "spelling-near")
    links = found.filter(F.col("best_n") >= factor * F.col("n")).select("id", F.col("best_id").alias("form"), F.col("best_id").alias("root"))
    links = written(links, "spelling-links")
    most = words.agg(F.max("n")).first()[0] or least_n
    length = max(1, int(math.log(max(most, 1) / max(least_n, 1), factor) + 1e-9)) if factor > 1 else words.count()
    for _ in range(math.ceil(math.log2(length)) if length > 1 else 0):
        onward = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        links = written(links.join(onward, "root", "left").select("id", "form", F.coalesce("further", "root").alias("root")), "spelling-links")
    named = links.join(words.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form").join(
        words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "form_word", "root_word")
    out = found.join(words.select("id", "word"), "id").join(named, "id", "left")
    form = F.col("form_word")
    return out.select("word", form.alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))


def write_groups(docs: DataFrame, path: str | None = None, **settings) -> str:
    """The groups as Parquet, for a normaliser to read: (word, root) of words
    that have a form. Returns the folder."""
    path = path or shared_folder(docs.sparkSession, "spelling-groups")
    variant_groups(docs, **settings).filter(F.col("form").isNotNull()).select("word", "root").write.mode("overwrite").parquet(path)
    return path
