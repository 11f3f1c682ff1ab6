"""Benchmark decontamination with suffix arrays of the training text (operator 1).

The training text is cut into shards of whole documents. A task turns a shard
into word codes (a word the benchmark lacks is 0 and matches nothing), builds
the shard's suffix array over word positions, and binary-searches every suffix
of every benchmark item in it, word by word: the range of training suffixes
that share the first d words narrows with d. The range at d = ``window`` holds
all places of that window, whose words are marked as hit. Documents never cross
shards, so nothing is shuffled.

How far matches go on is asked once per place and not per pair of place and
suffix: the marked words and the items found among them get order-preserving
ranks of their next 1, 2, 4, ... words, and each place narrows its range in the
items' suffix array by the largest power that still fits, so a match of n words
takes log n steps. Work and memory are those of a sort of the shard, whatever
repeats in it.

The suffix array holds the positions from which at least as many known words
follow as the shortest window has; no other position can hold a window.

Codes come from 64-bit word hashes; before anything is marked, the words of the
found windows are compared with the benchmark's byte by byte, and a word that
only shares the hash becomes 0.

The benchmark reaches tasks as broadcast blocks of at most BLOCK_BYTES of text
(plus one item). One block is the usual case; more blocks are searched one
after another, with the rows written to the shared folder between them.
"""
from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD_TABLE, by_bytes, texts_of, written

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 3 << 20
HASHED_WORDS = 100_000
PAIRS = 1 << 20          # (text, item) pairs held at once before repeats go
_LUT = np.frombuffer(bytes(0 if b == 0x20 else b for b in WORD_TABLE), dtype=np.uint8)


@cache
def hash_table(seed: int) -> np.ndarray:
    """A random odd number for each (place in the word modulo 64, byte)."""
    return np.random.default_rng(seed).integers(1 << 63, size=64 * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of some texts: place, length, owner and hash of each."""

    def __init__(self, texts: list[bytes], seed: int = 0):
        self.n_texts = len(texts)
        self.raw = _LUT[np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)]
        inside = self.raw != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, end = edges[::2] + 1, edges[1::2] + 1
        self.length = end - self.start
        begin = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.owner = np.searchsorted(begin, self.start, side="right") - 1
        self.per_text = np.bincount(self.owner, minlength=self.n_texts)[:self.n_texts]
        self.hash = np.zeros(len(self.start), dtype=np.uint64)
        for i in range(0, len(self.start), HASHED_WORDS):       # bounded, whatever the text's length
            j = min(i + HASHED_WORDS, len(self.start))
            length = self.length[i:j]
            chars = self.raw[self.start[i]:end[j - 1]]
            chars = chars[chars != 0]
            first = np.cumsum(length) - length
            at = np.arange(len(chars), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
            value = hash_table(seed)[(at & 63) * 256 + chars]
            if at.max() >= 64:
                value = value * ((at >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            self.hash[i:j] = np.add.reduceat(value, first) ^ length.astype(np.uint64)
        #: place of each word in the code sequence, where a 0 ends each text
        self.slot = np.arange(len(self.start)) + self.owner

    def codes(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start) + self.n_texts + 1, dtype=np.int64)
        out[self.slot] = code
        return out


class Block:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        for self.seed in range(100):             # until no two words of the block share a hash
            words = Words([t for _, t in items], self.seed)
            spelt = {bytes(words.raw[a:a + n]) for a, n in zip(words.start.tolist(), words.length.tolist(), strict=True)}
            if len(np.unique(words.hash)) == len(spelt):
                break
        self.items = [i for i, _ in items]
        self.vocab, first, code = np.unique(words.hash, return_index=True, return_inverse=True)
        self.words = words
        self.spelt = first                       # where each word of the vocabulary is spelt
        self.codes = words.codes(code + 1)
        self.at = words.slot                     # every suffix of every item
        self.item = words.owner
        n = words.per_text[words.owner]
        place = np.arange(len(words.start)) - (np.cumsum(words.per_text) - words.per_text)[words.owner]
        size = np.minimum(window, n)
        self.window = np.where(place <= n - size, size, 0)   # 0: no window starts here
        self.shortest = int(size.min()) if len(size) else 0


def suffix_array(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of the codes that follow, up to a 0
    or ``depth`` codes. Groups that still tie are sorted by their next two
    codes, round by round."""
    order = at.copy()
    padded = np.concatenate([codes, np.zeros(2, dtype=np.int64)])
    key = padded[order] << 32 | padded[np.minimum(order + 1, len(codes))]
    by = np.argsort(key, kind="stable")
    order, key = order[by], key[by]
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    live = (key & 0xFFFFFFFF) != 0
    at_depth = 2
    while at_depth < depth:
        same = ~new
        tied = (same | np.append(same[1:], False)) & live
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        pos = order[where]
        a = padded[np.minimum(pos + at_depth, len(codes))]
        b = np.where(a != 0, padded[np.minimum(pos + at_depth + 1, len(codes))], 0)
        key = a << 32 | b
        by = np.lexsort((key, group))
        order[where] = pos[by]
        key = key[by]
        differs = np.ones(len(where), dtype=bool)
        differs[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[where] |= differs
        live[where] = (key & 0xFFFFFFFF) != 0
        at_depth += 2
    return order


def _edge(codes, sa, lo, hi, depth, code, right):
    """In each [lo, hi), the first place whose code at ``depth`` isn't below
    (``right``: is above) ``code``."""
    lo, hi, depth = lo.copy(), hi.copy(), np.broadcast_to(depth, lo.shape)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) >> 1
        there = codes[sa[mid] + depth[open_]]
        below = there <= code[open_] if right else there < code[open_]
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)
    return lo


def search(codes: np.ndarray, sa: np.ndarray, block: Block) -> np.ndarray:
    """Per benchmark suffix that starts a window: the range of training suffixes
    that begin with it."""
    n = len(block.at)
    lo, hi = np.zeros(n, dtype=np.int64), np.full(n, len(sa), dtype=np.int64)
    at_window = np.zeros((2, n), dtype=np.int64)
    live, depth = np.flatnonzero(block.window), 0
    while len(live):
        code = block.codes[block.at[live] + depth]
        a = _edge(codes, sa, lo[live], hi[live], depth, code, False)
        b = _edge(codes, sa, a, hi[live], depth, code, True)
        found = a < b
        live, a, b = live[found], a[found], b[found]
        lo[live], hi[live] = a, b
        depth += 1
        full = block.window[live] == depth
        at_window[0, live[full]], at_window[1, live[full]] = a[full], b[full]
        live = live[~full]
    return at_window


def _ranks(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For 1, 2, 4, ... codes the ranks of what follows each position, cut at a
    0 (rank 0: a 0 stands there), and how many codes come before the next 0."""
    zero = np.flatnonzero(codes == 0)
    known = zero[np.searchsorted(zero, np.arange(len(codes)))] - np.arange(len(codes))
    ranks, step = [np.unique(codes, return_inverse=True)[1]], 1
    while step < known.max(initial=0):
        after = np.where(known > step, ranks[-1][np.minimum(np.arange(len(codes)) + step, len(codes) - 1)], 0)
        ranks.append(np.unique(ranks[-1] * np.int64(len(codes) + 1) + after, return_inverse=True)[1])
        step *= 2
    return ranks, known


def longest(text: np.ndarray, place: np.ndarray, items: np.ndarray, suffix: np.ndarray):
    """For each place of ``text``: the most codes from there that some suffix of
    ``items`` begins with, and the range of such suffixes in the returned order.
    Both sequences have a 0 behind each part."""
    codes = np.concatenate([text, np.zeros(1, dtype=np.int64), items, np.zeros(1, dtype=np.int64)])
    ranks, known = _ranks(codes)
    at = suffix + len(text) + 1
    order = np.argsort(ranks[-1][at], kind="stable")
    sa = at[order]
    lo, hi, depth = np.zeros(len(place), dtype=np.int64), np.full(len(place), len(sa), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero(known[place + depth] >= 1 << k)
        key = ranks[k][place[live] + depth[live]]
        a = _edge(ranks[k], sa, lo[live], hi[live], depth[live], key, False)
        b = _edge(ranks[k], sa, a, hi[live], depth[live], key, True)
        on = a < b
        live = live[on]
        lo[live], hi[live] = a[on], b[on]
        depth[live] += 1 << k
    return depth, lo, hi, order


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after another."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())


def scan(texts: list[bytes], block: Block):
    """Of each text: number of words, which words are hit (as a mask over the
    words of all texts), items with occurring windows, and the longest match
    (words, item, first word)."""
    words = Words(texts, block.seed)
    hit = np.zeros(len(words.start) + 1, dtype=np.int64)
    items: list[list[int]] = [[] for _ in texts]
    top = np.zeros(len(texts), dtype=np.int64)
    top_item, top_at = np.full(len(texts), -1), np.full(len(texts), -1)
    first = np.cumsum(words.per_text) - words.per_text
    if not len(block.vocab) or not len(words.start):
        return words, hit[:-1] > 0, items, top, top_item, top_at
    code = np.searchsorted(block.vocab, words.hash)
    code[code == len(block.vocab)] = 0
    code = np.where(block.vocab[code] == words.hash, code + 1, 0)
    while True:
        codes = words.codes(code)
        # positions followed by enough known words
        stop = np.flatnonzero(codes == 0)
        known = stop[np.searchsorted(stop, words.slot)] - words.slot
        sa = suffix_array(codes, words.slot[known >= block.shortest], int(block.window.max()))
        at_window = search(codes, sa, block)
        got = np.flatnonzero(at_window[1] > at_window[0])
        if not len(got):
            break
        lo, hi, size = at_window[0, got], at_window[1, got], block.window[got]
        _, one, which = np.unique(np.stack([lo, hi, size]), axis=1, return_index=True, return_inverse=True)
        which = which.ravel()                    # of each suffix, its window among the distinct ones
        slot = sa[_ranges(lo[one], hi[one])]
        length = np.repeat(size[one], hi[one] - lo[one])
        word = np.searchsorted(words.slot, slot)
        hit[:] = 0
        np.add.at(hit, word, 1)
        np.subtract.at(hit, word + length, 1)
        marked = np.cumsum(hit)[:-1] > 0
        wrong = _unlike(words, np.flatnonzero(marked), code, block)
        if len(wrong):                           # same hash, other word
            code[wrong] = 0
            continue
        # items and texts of each distinct window, put together in bounded parts
        of, owner = np.repeat(np.arange(len(one)), hi[one] - lo[one]), words.owner[word]
        held = np.unique(np.stack([of, owner]), axis=1)
        has = np.unique(np.stack([which, block.item[got]]), axis=1)
        first_item, past_item = np.searchsorted(has[0], held[0]), np.searchsorted(has[0], held[0], "right")
        cuts = np.searchsorted(np.cumsum(past_item - first_item), np.arange(0, int((past_item - first_item).sum()) + 1, PAIRS))
        pair = np.zeros(0, dtype=np.int64)
        for a, z in zip(cuts, [*cuts[1:], held.shape[1]], strict=True):
            there = has[1][_ranges(first_item[a:z], past_item[a:z])]
            pair = np.union1d(pair, np.repeat(held[1][a:z], (past_item - first_item)[a:z]) * len(block.items) + there)
        for p in pair.tolist():
            items[p // len(block.items)].append(p % len(block.items))
        # the longest verbatim match of each text
        least = np.full(len(one), len(block.items), dtype=np.int64)
        np.minimum.at(least, which, block.item[got])
        own, lead = _longest_of(codes, words, marked, word, size[one][of], least[of], np.unique(pair % len(block.items)), block)
        by = np.lexsort((own, lead[1], -lead[0], words.owner[own]))
        best = by[np.unique(words.owner[own][by], return_index=True)[1]]
        text = words.owner[own[best]]
        top[text], top_item[text], top_at[text] = lead[0][best], lead[1][best], own[best] - first[text]
        return words, marked, items, top, top_item, top_at
    return words, np.zeros(len(words.start), dtype=bool), items, top, top_item, top_at


def _longest_of(codes, words: Words, marked, word, size, least, found: np.ndarray, block: Block):
    """The words where a window starts, and of each the length and the smallest
    item of the longest match from there; ``word``, ``size`` and ``least``: places,
    lengths and smallest items of the windows."""
    by = np.lexsort((least, -size, word))
    lead = by[np.unique(word[by], return_index=True)[1]]
    own, length, item = word[lead], size[lead].copy(), least[lead].copy()
    # marked words and found items in sequences of their own, with a 0 behind each run
    slot = words.slot[marked]
    place = np.arange(len(slot)) + np.cumsum(np.concatenate([[0], np.diff(slot) > 1]).astype(np.int64)) if len(slot) else slot
    text = np.zeros(int(place[-1]) + 2, dtype=np.int64)
    text[place] = codes[slot]
    chosen = np.flatnonzero(np.isin(block.item, found))
    at = np.arange(len(chosen)) + np.searchsorted(found, block.item[chosen])
    theirs = np.zeros(len(chosen) + len(found) + 1, dtype=np.int64)
    theirs[at] = block.codes[block.at[chosen]]
    full = int(block.window.max())
    depth, lo, hi, order = longest(text, place[np.searchsorted(slot, words.slot[own])], theirs, at)
    on = np.flatnonzero(depth >= full)           # a shorter match is a window only as a whole item
    length[on] = np.maximum(length[on], depth[on])
    # items of the longest of each text alone
    top = np.zeros(words.n_texts, dtype=np.int64)
    np.maximum.at(top, words.owner[own], length)
    on = on[length[on] == top[words.owner[own[on]]]]
    spans, back = np.unique(np.stack([lo[on], hi[on]]), axis=1, return_inverse=True)
    rows = block.item[chosen[order]]
    smallest = np.array([rows[a:z].min() for a, z in spans.T.tolist()], dtype=np.int64)
    if len(on):
        item[on] = smallest[back.ravel()]
    return own, (length, item)


def _unlike(words: Words, which: np.ndarray, code: np.ndarray, block: Block) -> np.ndarray:
    """Of the words ``which``, those not spelt like the benchmark word of their code."""
    theirs = block.spelt[code[which] - 1]
    bad = words.length[which] != block.words.length[theirs]
    size = words.length[which]
    for n in np.unique(size[~bad]).tolist():
        own = np.flatnonzero(~bad & (size == n))
        step = np.arange(n)
        for i in range(0, len(own), 100_000):
            o = own[i:i + 100_000]
            a = words.raw[words.start[which[o]][:, None] + step]
            b = block.words.raw[block.words.start[theirs[o]][:, None] + step]
            bad[o] |= (a != b).any(axis=1)
    return which[bad]


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The benchmark in blocks of bounded size, each a broadcast variable."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = sorted(((r.item if r.item is not None else "null", r.text.encode()) for r in own.collect()))
        yield benchmark.sparkSession.sparkContext.broadcast((rows, window))


_ready: dict[int, Block] = {}


def _block(shared) -> Block:
    if shared.value is not _ready.get("of"):
        _ready["of"], _ready["block"] = shared.value, Block(*shared.value)
    return _ready["block"]


SPAN = T.StructType().add("first", T.IntegerType()).add("past", T.IntegerType())
FOUND = (T.StructType().add("n_words", T.LongType()).add("spans", T.ArrayType(SPAN)).add("items", T.ArrayType(T.StringType()))
         .add("longest_match", T.LongType()).add("longest_item", T.StringType()).add("longest_at", T.LongType()))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``found``: n_words; the runs of hit words
    (``spans``: first word, word past the end); the ids of items with occurring
    windows, sorted as strings; length, item and first word of the longest
    verbatim match that starts at a window (ties: smallest item row, then first
    place; null if there is none).

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter item. Null or wordless texts have no words, items without words no
    window; a null item_id reads "null"; items with one id count once; repeated
    documents get a row each; a text of any length, however repetitive, is one
    shard's sort of its words (about 100 bytes a word); an empty benchmark marks nothing; a column of
    ``docs`` called ``found`` is replaced.
    """
    keep = [c for c in docs.columns if c != "found"]
    schema = T.StructType([f for f in docs.schema.fields if f.name != "found"]).add("found", FOUND)
    kind = to_arrow_type(FOUND)
    out = docs
    for k, shared in enumerate(_blocks(benchmark, window, block_bytes)):
        def run(batches, shared=shared, k=k):
            block = _block(shared)
            for b in batches:
                texts = texts_of(b.column(text))
                before = b.column("found").to_pylist() if k else None
                found = []
                for i, j in by_bytes(texts, SHARD_BYTES):
                    found += _rows(texts[i:j], block, before[i:j] if k else None)
                rows = [dict(zip(kind.names, x, strict=True)) for x in found]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, kind)], [*keep, "found"])

        if k:
            out = written(out, "decontaminate")
        out = out.select(*(F.col(f"`{c}`") for c in keep), *(["found"] if k else [])).mapInArrow(run, schema)
    return out


def _rows(texts: list[bytes], block: Block, before):
    words, marked, items, top, top_item, top_at = scan(texts, block)
    past = np.cumsum(words.per_text)
    out = []
    plain = np.bincount(words.owner[marked], minlength=len(texts)) == 0
    for d in range(len(texts)):
        n = int(words.per_text[d])
        if plain[d]:
            row = (n, [], [], 0, None, None)
        else:
            m = np.concatenate([[False], marked[past[d] - n:past[d]], [False]])
            e = np.flatnonzero(m[1:] != m[:-1]).tolist()
            row = (n, list(zip(e[::2], e[1::2], strict=True)), sorted({block.items[i] for i in items[d]}), int(top[d]), block.items[top_item[d]], int(top_at[d]))
        out.append(row if before is None else _joined(row, before[d]))
    return [(n, [{"first": a, "past": b} for a, b in s], i, t, ti, ta) for n, s, i, t, ti, ta in out]


def _joined(row, old):
    """What two blocks found in one document."""
    spans: list[list[int]] = []
    for a, b in sorted([*row[1], *((s["first"], s["past"]) for s in old["spans"])]):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    best = max((row[3:], (old["longest_match"], old["longest_item"], old["longest_at"])), key=lambda x: x[0])
    return (row[0], [tuple(s) for s in spans], sorted({*row[2], *old["items"]}), *best)


def _n_hit():
    return F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + (s["past"] - s["first"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least one
    word in ``share`` is hit) and the longest match, one row per document."""
    found = overlaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window)
    return found.select("doc_id", "found.n_words", _n_hit().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
                        ((_n_hit() > 0) & (share * _n_hit() >= F.col("found.n_words"))).alias("contaminated"),
                        "found.longest_match", "found.longest_item", "found.longest_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated rows; columns as they were."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    found = overlaps(row, benchmark, window)
    return found.where(~((_n_hit() > 0) & (share * _n_hit() >= F.col("found.n_words")))).select("row.*")
