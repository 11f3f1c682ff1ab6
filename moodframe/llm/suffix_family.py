"""Suffix-array deduplication with a logarithmic index family (operator 8).

Every byte is removed that a ``size``-byte string covers which also starts
earlier. Strings are suffixes cut to ``size`` bytes.

Which strings can be equal. The key of a string is the smallest hash among its
GRAM-byte substrings, so equal strings have equal keys and keys decide where
strings meet. Neighbouring strings mostly share their smallest gram: a text
falls into runs of strings with one smallest gram, about one run in 40 bytes, and
runs are what is shuffled, with the bytes they span.

1. Keys are counted. Those that come once can't match; those that come twice or
   more go into a bitmap (two bits a key, at most BITMAP_BITS bits; a wrong bit
   costs work, never a result), and so do hot ones.
2. Runs with a repeated key are sent to the shard of their key. A run that a
   batch of documents holds twice is sent once; its later copies are covered
   already. A hot key's strings are sent one by one by their own hash, with a
   second hash in place of the bytes (128 bits together), so a passage in very
   many documents is spread over shards and sent once per batch.
3. A shard puts equal runs together, and for keys with different runs takes the
   strings in text order, batch by batch, through a ``SuffixFamily``: a batch
   gets a suffix array, is merge-scanned against the sorted array of every
   level, and what is new becomes a level; levels of one size merge into one of
   twice that size. Here the bytes themselves are compared (but for hot strings).

Spans come back per document and are cut out of its bytes.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, texts_of, written

SIZE = 100
GRAM = 24
CHUNK_BYTES = 1 << 18           # bytes hashed at once
HOT_RUNS = 8000                 # runs of one key from which its strings go separately
BITMAP_BITS = 1 << 29
SHARD_BYTES = 16 << 20
SENT_BYTES = 4 << 20            # text whose runs are put together before they are sent
SLICE_STRINGS = 1 << 17         # strings of whole keys that a shard works on at once
BATCH_STRINGS = 1 << 14
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(8).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


class Rolling:
    """Polynomial hashes (modulo 2**64) of the n bytes from each place, made by
    doubling."""

    def __init__(self, data: np.ndarray):
        self.by = {1: _TABLE[data]}

    def _doubled(self, n: int) -> np.ndarray:
        if n not in self.by:
            half = self._doubled(n // 2)
            self.by[n] = half[:-(n // 2)] * _power(n // 2) + half[n // 2:] if len(half) > n // 2 else half[:0]
        return self.by[n]

    def of(self, n: int) -> np.ndarray:
        out, have = None, 0
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                part = self._doubled(1 << bit)
                if out is None:
                    out = part
                else:
                    m = max(0, len(part) - have)
                    out = out[:m] * _power(1 << bit) + part[have:have + m]
                have += 1 << bit
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, out = 1, x
    while 2 * n <= width:
        out, n = np.minimum(out[:-n], out[n:]), 2 * n
    if n < width:
        m = len(x) - width + 1
        out = np.minimum(out[:m], out[width - n:width - n + m])
    return out


def runs_of(texts: list[bytes], size: int, gram: int, whole: bool) -> Iterator[tuple]:
    """For pieces of the texts: (bytes, string keys, two hashes of the strings
    or None, run starts, run lengths, owner of each run, its start in the text).
    A run has one owner and one place of the smallest gram, so it holds no two
    equal strings, and at most size - gram + 1 strings."""
    for a, b in by_bytes(texts, CHUNK_BYTES):
        # a text that is longer than a chunk goes in overlapping pieces
        part = texts[a:b]
        steps = range(0, len(part[0]) - size + 1, 4 * CHUNK_BYTES) if b - a == 1 and len(part[0]) > 4 * CHUNK_BYTES else [None]
        for at in steps:
            own = part if at is None else [part[0][at:at + 4 * CHUNK_BYTES + size - 1]]
            length = np.array([len(t) for t in own])
            data = np.frombuffer(b"".join(own), dtype=np.uint8)
            if len(data) < size:
                continue
            rolling = Rolling(data)
            grams = mixed(rolling.of(gram))
            least = sliding_min(grams, size - gram + 1)
            keys = mixed(least)
            strings = (mixed(rolling.of(size)), rolling.of(size // 2)) if whole else None
            end = np.cumsum(length)
            owner = np.repeat(np.arange(len(own)), length)[:len(keys)]
            valid = np.arange(len(keys)) + size <= end[owner]
            new = np.ones(len(keys), dtype=bool)
            # ends where the place of the (leftmost) smallest gram changes
            new[1:] = (keys[1:] != keys[:-1]) | (least[:-1] == grams[:len(least) - 1]) | (valid[1:] != valid[:-1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(keys)))
            start, n = start[valid[start]], n[valid[start]]
            who = owner[start]
            yield data, keys, strings, start, n, who + a, start - (end - length)[who] + (at or 0)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ---- counting keys -----------------------------------------------------------
def key_counts(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(key, n) of every key with two runs or more."""
    def run(batches):
        for b in batches:
            keys = [k[s] for _, k, _, s, *_ in runs_of(texts_of(b.column(0)), size, gram, False)]
            value, n = np.unique(np.concatenate(keys or [np.zeros(0, dtype=np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(value), pa.array(n, pa.int64())], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Two bits set for each key, in ``bits`` (a power of two) bits."""
    spots = keys.select(F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(max(1, bits // 64), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return out


def in_bitmap(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    top = np.uint64(len(words) * 64 - 1)

    def has(at):
        return words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
    return has(keys & top) & has(keys >> np.uint64(32) & top)


# ---- sending runs ----------------------------------------------------------------
_SENT = "shard long, doc_id long, text_hash long, first long, n long, body binary"
_SENT_NAMES = [f.split()[0] for f in _SENT.split(", ")]
_RANK_NULL = (1 << 63) - 1


def _order(doc: np.ndarray, text_hash: np.ndarray, first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    return np.lexsort((first, text_hash, doc, *more))


def sent_runs(docs: DataFrame, repeated, hot, size: int, gram: int) -> DataFrame:
    """Runs with a repeated key: shard, doc_id (null last: the largest long),
    text_hash, first string, number of strings, bytes. A null ``body`` says that
    the strings are known to come earlier."""
    def run(batches):
        for b in batches:
            every = texts_of(b.column(0))
            for i, j in by_bytes(every, SENT_BYTES):
                yield from batch(every[i:j], b.column(1)[i:j].to_numpy(zero_copy_only=False), b.column(2)[i:j].to_numpy(zero_copy_only=False))

    def batch(texts, doc, text_hash):
        parts = []
        for data, keys, strings, start, n, who, first in runs_of(texts, size, gram, True):
            fit = in_bitmap(keys[start], repeated.value)
            start, n, who, first = start[fit], n[fit], who[fit], first[fit]
            apart = in_bitmap(keys[start], hot.value)
            k = np.repeat(np.flatnonzero(apart), n[apart])          # a hot key's strings one by one
            off = np.arange(len(k)) - np.repeat(np.cumsum(n[apart]) - n[apart], n[apart])
            alone = start[k] + off
            raw = data.tobytes()
            second = strings[1][alone].astype("<u8").tobytes()
            bodies = [raw[s:s + m] for s, m in zip(start[~apart].tolist(), (n[~apart] + size - 1).tolist(), strict=True)] + [second[x:x + 8] for x in range(0, len(second), 8)]
            shard = np.concatenate([keys[start[~apart]], strings[0][alone]])
            start, who, first = (np.concatenate([x[~apart], y]) for x, y in ((start, alone), (who, who[k]), (first, first[k] + off)))
            n = np.concatenate([n[~apart], np.ones(len(k), dtype=n.dtype)])
            same = mixed(strings[0][start] * np.uint64(3) + strings[0][start + n - 1] * np.uint64(_BASE) + n.astype(np.uint64))
            parts.append((shard, same, doc[who], text_hash[who], first, n, bodies))
        if not parts:
            return
        shard, body, d, t, first, n = (np.concatenate([p[k] for p in parts]) for k in range(6))
        bytes_ = np.empty(len(shard), dtype=object)
        bytes_[:] = [x for p in parts for x in p[6]]
        del parts
        by = _order(d, t, first, body, shard)
        same = np.zeros(len(by), dtype=bool)
        same[1:] = (shard[by][1:] == shard[by][:-1]) & (body[by][1:] == body[by][:-1])
        later = np.zeros(len(by), dtype=bool)
        later[by] = same & _later(d[by], t[by], first[by], same)
        s = np.flatnonzero(~later)
        for i in range(0, len(s), 20_000):
            yield _sent(shard, d, t, first, n, bytes_, s[i:i + 20_000])
        # what comes later: whole stretches of strings
        s = np.flatnonzero(later)
        s = s[_order(d[s], t[s], first[s])]
        past = first[s] + n[s]
        cut = np.ones(len(s), dtype=bool)
        cut[1:] = (d[s][1:] != d[s][:-1]) | (t[s][1:] != t[s][:-1]) | (first[s][1:] > past[:-1])
        lead = s[cut]
        if len(lead):
            n[lead] = np.maximum.reduceat(past, np.flatnonzero(cut)) - first[lead]
            bytes_[lead] = None
            yield _sent(shard, d, t, first, n, bytes_, lead)

    return docs.select("text", "doc_id", "text_hash").mapInArrow(run, _SENT)


def _sent(shard, doc, text_hash, first, n, bodies, rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(shard[rows]), pa.array(doc[rows], pa.int64()), pa.array(text_hash[rows], pa.int64()), pa.array(first[rows], pa.int64()),
                                       pa.array(n[rows], pa.int64()), pa.array(bodies[rows].tolist(), pa.binary())], _SENT_NAMES)


def _later(doc, text_hash, first, same) -> np.ndarray:
    """In groups of equal strings in text order (``same``: as the one before):
    whether a place is another one than the group's first. Rows that repeat a
    document repeat its places."""
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return (doc != doc[lead]) | (text_hash != text_hash[lead]) | (first != first[lead])


# ---- shards --------------------------------------------------------------------------
class SuffixFamily:
    """Sorted arrays of distinct suffixes, sizes growing geometrically."""

    def __init__(self, size: int):
        self.kind = f"S{size + 1}"      # with a last byte, since S arrays drop zero bytes at the end
        self.levels: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Takes a batch in text order; whether each suffix came before, in an
        earlier batch or in this one."""
        array = np.argsort(suffixes, kind="stable")
        ordered = suffixes[array]
        known = np.zeros(len(array), dtype=bool)
        known[1:] = ordered[1:] == ordered[:-1]
        one = np.flatnonzero(~known)
        found = np.zeros(len(one), dtype=bool)
        for level in self.levels:
            found |= self._scan(level, ordered[one])
        back = np.zeros(len(array), dtype=bool)
        back[array] = known | found[np.cumsum(~known) - 1]
        if not found.all():
            self._keep(ordered[one[~found]])
        return back

    @staticmethod
    def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([a, b])
        order = np.argsort(both, kind="stable")     # merges the two sorted stretches
        return both[order], order

    def _scan(self, level: np.ndarray, new: np.ndarray) -> np.ndarray:
        both, order = self._merged(level, new)
        out = np.zeros(len(new), dtype=bool)
        out[order[1:][both[1:] == both[:-1]] - len(level)] = True
        return out

    def _keep(self, level: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) < 2 * len(level):
            level, _ = self._merged(self.levels.pop(), level)
        self.levels.append(level)


def strings_of(bodies: list[bytes], n: np.ndarray, size: int) -> np.ndarray:
    """All strings of the runs, one after another."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    start = np.cumsum(n + size - 1) - (n + size - 1)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.ones((len(at), size + 1), dtype=np.uint8)
    out[:, :size] = np.lib.stride_tricks.sliding_window_view(data, size)[at]
    return out.view(f"S{size + 1}").ravel()


def repeated_strings(shard, doc, text_hash, first, n, bodies, size: int):
    """Of the runs of one shard: (run, string from, string past) of every
    stretch of strings that start earlier too."""
    ids: dict[bytes, int] = {}
    body = np.fromiter((ids.setdefault(x, len(ids)) for x in bodies), dtype=np.int64, count=len(bodies))
    by = _order(doc, text_hash, first, body, shard)
    shard_, body_ = shard[by], body[by]
    same = np.zeros(len(by), dtype=bool)
    same[1:] = (shard_[1:] == shard_[:-1]) & (body_[1:] == body_[:-1])
    later = same & _later(doc[by], text_hash[by], first[by], same)
    run, a, z = [by[later]], [np.zeros(later.sum(), dtype=np.int64)], [n[by[later]]]
    # different runs under one key (a hot string has no bytes here)
    lead = by[~same]
    lead = lead[np.fromiter((len(bodies[i]) >= size for i in lead.tolist()), dtype=bool, count=len(lead))]
    _, inverse, count = np.unique(shard[lead], return_inverse=True, return_counts=True)
    lead = lead[count[inverse] > 1]
    key = shard[lead]
    lead = lead[np.argsort(key, kind="stable")]
    key = shard[lead]
    group = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.add.reduceat(n[lead], group) if len(group) else group
    slice_of = np.repeat((np.cumsum(sizes) - sizes) // SLICE_STRINGS, np.diff(np.append(group, len(lead))))
    for s in np.unique(slice_of):
        own = lead[slice_of == s]
        own = own[_order(doc[own], text_hash[own], first[own])]
        family, i = SuffixFamily(size), 0
        cuts = [*np.flatnonzero(np.diff((np.cumsum(n[own]) - 1) // BATCH_STRINGS)) + 1, len(own)]
        for j in cuts:
            batch = own[i:j]
            i = j
            flat = family.add(strings_of([bodies[k] for k in batch], n[batch], size))
            edge = np.cumsum(n[batch])
            flat = np.insert(flat, edge, False)          # a stretch ends with its run
            e = np.flatnonzero(np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8)))
            lo, hi = e[::2], e[1::2]
            k = np.searchsorted(edge + np.arange(len(edge)), lo, side="right")
            base = (edge - n[batch] + np.arange(len(edge)))[k]
            run.append(batch[k])
            a.append(lo - base)
            z.append(hi - base)
    return np.concatenate(run), np.concatenate(a), np.concatenate(z)


def shard_spans(sent: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, first byte, byte past the end of covered stretches."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        shard, doc, text_hash, first, n = (t.column(k).to_numpy() for k in range(5))
        body = t.column(5).combine_chunks()
        known = np.asarray(body.is_null())
        bodies = body.filter(pa.array(~known)).to_pylist()
        keep = np.flatnonzero(~known)
        r, a, z = repeated_strings(shard[keep], doc[keep], text_hash[keep], first[keep], n[keep], bodies, size)
        gone = np.flatnonzero(known)
        r, a, z = np.concatenate([keep[r], gone]), np.concatenate([a, np.zeros(len(gone), dtype=np.int64)]), np.concatenate([z, n[gone]])
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(text_hash[r]), pa.array(first[r] + a), pa.array(first[r] + z + size - 1)], ["doc_id", "text_hash", "first", "past"])

    return sent.mapInArrow(run, "doc_id long, text_hash long, first long, past long")


# ---- documents -----------------------------------------------------------------------------
def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_RANK_NULL)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id (null as the largest long), text_hash and ``spans`` (first, past)
    of every document that has a covered byte; spans may touch or overlap."""
    slim = _keyed(docs)
    counts = written(key_counts(slim, size, gram), "suffix-keys")
    n, total, hottest = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") >= hot_runs)).first()
    context = docs.sparkSession.sparkContext

    def bits(k):
        return min(BITMAP_BITS, 1 << max(6, math.ceil(math.log2(12 * k + 1))))
    repeated = context.broadcast(bitmap(counts, bits(n)))
    hot = context.broadcast(bitmap(counts.where(F.col("n") >= hot_runs), bits(hottest)))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 2 * size / SHARD_BYTES))
    sent = sent_runs(slim, repeated, hot, size, gram).repartition(shards, "shard")
    return shard_spans(sent, size).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "past")).alias("spans"))


def _cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, maximal runs removed."""
    merged: list[list[int]] = []
    for s in sorted((x["first"], x["past"]) for x in spans or ()):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    left, at = [], 0
    for a, z in merged:
        left.append(text[at:a])
        at = z
    left.append(text[at:])
    return b"".join(left), sum(z - a for a, z in merged), len(merged)


def _with_spans(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``row`` (all columns of ``docs``) and its ``spans``."""
    found = repeated_spans(docs, size, gram).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "spans")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = (F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_RANK_NULL)) == F.col("_d")) & (F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))) == F.col("_t"))
    return rows.join(found, key, "left").select("row", "spans")


def dedup_report(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (of the remaining bytes), one row per row.

    A null text counts as empty; a text of fewer than ``size`` bytes has no
    string. A null doc_id comes after all others. Rows that repeat doc_id and
    text are one document; texts that share a doc_id go by a hash of the text.
    An empty table gives none.
    """
    def run(batches):
        for b in batches:
            out = [(len(t), *_cut(t, s)) for t, s in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), size, gram)
    return rows.select("row.doc_id", "row.text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``docs`` with the covered bytes cut out of its texts; a cut within a
    character leaves replacement characters. Columns and rows stay as they were."""
    names, text = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            columns = b.column(0).flatten()
            cut = [t if not s else _cut((t or "").encode(), s)[0].decode("utf-8", "replace") for t, s in zip(columns[text].to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns[text] = pa.array(cut, columns[text].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_spans(docs, size, gram).mapInArrow(run, docs.schema)
