"""Counts of word and character n-grams by blocks of whole texts.

Inside a task n-grams are whole numbers: words or characters get numbers, an
n-gram is its first n - 1 units' number and the last unit's. A block gives one
row per distinct n-gram (documents, occurrences), or per row and term of a
vocabulary, so Spark sums and shuffles counts, not places. A block holds at most
BLOCK units unless one text is longer; texts are never cut.

A vocabulary of the k commonest word n-grams is found length by length: an n-gram
occurs no more often than the shorter ones in it, so only those are counted whose
parts reach the k-th largest count so far. That is exact; with more than CANDIDATES
such parts the caller counts everything.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 1 << 20
CANDIDATES = 200_000
STATS = "term string, df long, ctf long"


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` units, or one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, z
        a = z


def _rows_and_room(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's row, and how many units its row has from it on."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))


def _words(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return lists.flatten(), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def _characters(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points, and the length of each."""
    whole = "".join(texts.fill_null("").to_pylist())
    return whole, np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).astype(np.int64), pc.utf8_length(texts).fill_null(0).to_numpy().astype(np.int64)


def _dense(keys: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the distinct keys, and how many there are."""
    if bound > 1 << 24:
        found, number = np.unique(keys, return_inverse=True)
        return number, len(found)
    held = np.zeros(bound, dtype=bool)
    held[keys] = True
    return (np.cumsum(held) - 1)[keys], int(held.sum())


def _stats(number: np.ndarray, n: int, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and occurrences of each number."""
    return np.bincount(np.unique(number * rows + row) // rows, minlength=n), np.bincount(number, minlength=n)


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "df", "ctf"])


# ---- statistics ---------------------------------------------------------------------

def character_stats(df: DataFrame, text: Column, n_min: int, n_max: int) -> DataFrame:
    """(term, df, ctf) of all character n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, z in _blocks(pc.utf8_length(texts).fill_null(0).to_numpy().astype(np.int64), BLOCK):
                whole, points, sizes = _characters(texts.slice(a, z - a))
                row, room = _rows_and_room(sizes)
                unit, units = _dense(points, 0x110000)
                at, number, count = np.arange(len(unit)), unit, units
                for n in range(1, n_max + 1):
                    if n > 1:
                        going = room[at] >= n
                        at, number = at[going], number[going]
                        number, count = _dense(number * units + unit[at + n - 1], count * units)
                    if n >= n_min and count:
                        place = np.empty(count, dtype=np.int64)
                        place[number] = at
                        yield _batch([whole[p:p + n] for p in place.tolist()], *_stats(number, count, row[at], len(sizes)))
    parts = df.select(text.alias("_t")).mapInArrow(run, STATS)
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def _word_stats(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = _words(batch.column(0))
            ends = np.r_[0, np.cumsum(sizes)]
            for a, z in _blocks(sizes, BLOCK):
                coded = words.slice(ends[a], ends[z] - ends[a]).dictionary_encode()
                row, _ = _rows_and_room(sizes[a:z])
                if len(row):
                    yield _batch(coded.dictionary, *_stats(coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), row, z - a))
    return df.mapInArrow(run, STATS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def _longer_stats(df: DataFrame, parts: Terms, n: int) -> DataFrame:
    """(key, df, ctf) of the n-grams whose first and last n - 1 words are terms of ``parts``."""
    sent = df.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value
        for batch in batches:
            words, sizes = _words(batch.column(0))
            ends = np.r_[0, np.cumsum(sizes)]
            for a, z in _blocks(sizes, BLOCK):
                ids = parts.numbers(words.slice(ends[a], ends[z] - ends[a]))
                row, room = _rows_and_room(sizes[a:z])
                *_, at = parts.starts(ids, room)
                i = np.flatnonzero((at >= 0) & (room >= n))
                i = i[at[i + 1] >= 0]
                if len(i):
                    keys, number = np.unique(at[i] * len(parts.units) + ids[i + n - 1], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, *_stats(number, len(keys), row[i], z - a))], ["key", "df", "ctf"])
    return df.mapInArrow(run, "key long, df long, ctf long").groupBy("key").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def common_word_stats(df: DataFrame, tokens: Column, n_max: int, n_docs: int, k: int, min_df: int, max_count: float) -> DataFrame | None:
    """(term, df, ctf) of word n-grams up to ``n_max`` words, among them the ``k``
    of the largest ctf with ``min_df`` <= df <= ``max_count``; None if too many
    could be among them."""
    spark, df = df.sparkSession, df.select(tokens.alias("_g"))
    floor, kept = 1, []

    def raised(rows: list) -> int:
        best = sorted((c for _, d, c in rows if min_df <= d <= max_count), reverse=True)
        return max(floor, best[k - 1]) if len(best) >= k else floor

    for n in range(1, n_max + 1):
        if n == 1:
            found = materialize(_word_stats(df).filter(F.col("df") >= min_df), "word-stats")
            top = found.filter(F.col("df") <= F.lit(max_count)).orderBy(F.col("ctf").desc()).limit(k).collect()
            floor = raised([tuple(r) for r in top])
        else:
            parts = Terms.of([t.split(" ") for t, *_ in kept if t.count(" ") in (0, n - 2)])
            if not len(parts.units):
                break
            found = materialize(_longer_stats(df, parts, n).filter((F.col("df") >= min_df) & (F.col("ctf") >= floor)), "gram-stats")
        large = found.filter(F.col("ctf") >= floor)
        if len(kept) + large.count() > CANDIDATES:
            return None
        rows = [tuple(r) for r in large.collect()]
        kept += rows if n == 1 else [(" ".join(parts.term(key, n)), d, c) for key, d, c in rows]
        floor = raised(kept)
        kept = [r for r in kept if r[2] >= floor]
    return spark.createDataFrame(kept, STATS)


# ---- a vocabulary's terms in rows ------------------------------------------------------

@dataclass
class Terms:
    """N-grams as a tree. A node's key is its parent's number times the number of
    units, plus its unit; a level's keys are sorted, a node's number is its place.
    On the first level that is the unit's number."""
    units: list
    keys: list[np.ndarray]      # from the second level on
    place: list[np.ndarray]     # per level: the term's place in the list, -1 for the start of a longer one

    @classmethod
    def of(cls, grams: list) -> Terms:
        units = sorted({u for g in grams for u in g})
        number = {u: i for i, u in enumerate(units)}
        paths = [(i, number[g[0]], g) for i, g in enumerate(grams)]
        keys, place = [], []
        for n in range(1, max(map(len, grams), default=0) + 1):
            if n > 1:
                longer = [(i, at * len(units) + number[g[n - 1]], g) for i, at, g in paths if len(g) >= n]
                keys.append(np.unique(np.array([key for _, key, _ in longer], dtype=np.int64)))
                paths = list(zip((i for i, _, _ in longer), np.searchsorted(keys[-1], [key for _, key, _ in longer]).tolist(), (g for *_, g in longer), strict=True))
            own = np.full(len(keys[-1]) if n > 1 else len(units), -1, dtype=np.int64)
            for i, at, g in paths:
                if len(g) == n:
                    own[at] = i
            place.append(own)
        return cls(units, keys, place)

    def term(self, key: int, n: int) -> list:
        """The units of a key one level below the last, or of any level's key."""
        out = []
        for keys in reversed(self.keys[:n - 2]):
            key, unit = divmod(key, len(self.units))
            out.append(self.units[unit])
            key = int(keys[key])
        return [*(self.units[u] for u in divmod(key, len(self.units))), *reversed(out)]

    def numbers(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, value_set=pa.array(self.units, words.type)).fill_null(-1).to_numpy().astype(np.int64)

    def starts(self, ids: np.ndarray, room: np.ndarray) -> Iterator[np.ndarray]:
        """Level by level the node of the n units from each place on, or -1."""
        at = ids
        yield at
        for n, keys in enumerate(self.keys, 2):
            i = np.flatnonzero((at >= 0) & (room >= n))
            i = i[ids[i + n - 1] >= 0]
            key = at[i] * len(self.units) + ids[i + n - 1]
            j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[j] == key
            at = np.full(len(ids), -1, dtype=np.int64)
            at[i[hit]] = j[hit]
            yield at

    def counted(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term's place, occurrences), by row and place."""
        row, room = _rows_and_room(sizes)
        terms, found = sum(int((p >= 0).sum()) for p in self.place), []
        for place, at in zip(self.place, self.starts(ids, room), strict=False):
            i = np.flatnonzero(at >= 0)
            term = place[at[i]]
            found.append(row[i[term >= 0]] * terms + term[term >= 0])
        keys, tf = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]), return_counts=True)
        return keys // max(terms, 1), keys % max(terms, 1), tf


def word_terms(vocabulary: list[str]) -> Terms:
    return Terms.of([t.split(" ") for t in vocabulary])


def character_terms(vocabulary: list[str]) -> Terms:
    return Terms.of([[ord(c) for c in t] for t in vocabulary])


def counted_rows(terms: Terms, values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """``Terms.counted`` of lists of words or of texts, block by block with the
    first row and the row behind the last."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        words, sizes = _words(values)
        ends = np.r_[0, np.cumsum(sizes)]
        for a, z in _blocks(sizes, BLOCK):
            yield *terms.counted(terms.numbers(words.slice(ends[a], ends[z] - ends[a])), sizes[a:z]), a, z
        return
    units = np.array(terms.units, dtype=np.int64)
    number = np.full(0x110000, -1, dtype=np.int64)
    number[units] = np.arange(len(units))
    for a, z in _blocks(pc.utf8_length(values).fill_null(0).to_numpy().astype(np.int64), BLOCK):
        _, points, sizes = _characters(values.slice(a, z - a))
        yield *terms.counted(number[points], sizes), a, z


def term_rows(df: DataFrame, key: str, values: Column, terms: Terms) -> DataFrame:
    """(key, place, tf): occurrences of each term in each row."""
    sent = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, tf, a, _ in counted_rows(sent.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(place.astype(np.int32)), pa.array(tf)], [key, "idx", "tf"])
    return df.select(key, values.alias("_v")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, idx int, tf long")
