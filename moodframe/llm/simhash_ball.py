"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 6).

Two fingerprints differ in at most ``max_bits`` bits exactly if some 64-bit
value is within ceil(max_bits / 2) bits of one and floor(max_bits / 2) bits of
the other. So every fingerprint emits all variants within half the radius,
variants meet by value, and fingerprints that share one are linked.

The shuffle is on variants, in compact form. The bits are dealt into ``r``
groups; a variant's bucket is the parity of each group. Flipping one bit flips
one bit of the bucket, so a ball of radius 2 reaches only 1 + r + r(r-1)/2
buckets: a fingerprint is sent once to each of them, and the bucket's task
makes the variants that belong there. ``r`` grows with the number of
fingerprints, so a bucket holds about BUCKET_VARIANTS variants at any size; a
fuller one (similar fingerprints sit together) is worked in slices.

Equal fingerprints are one node before any of this. Fingerprints that share a
variant are linked in a star, not in all pairs. Components come from
``components``.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flips, texts_of, written
from .components import components

BUCKET_VARIANTS = 1 << 20
SLICE_VARIANTS = 1 << 22
BITS = 64
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, split at ASCII white
    space, each run of ``shingle`` words (space-joined; a shorter text is one
    run) hashed by XXH64; a bit is 1 if set in over half the hashes. No word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    past = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    ends = past[shingle - 1:].tolist()
    starts = [0, *(past[:n - 1] + 1).tolist()]
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 20):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[i:i + (1 << 20)], ends[i:i + (1 << 20)], strict=True)]
        octets = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        if len(part) < 64:
            counts += _BYTE_BITS[octets].sum(axis=0).ravel()
        else:
            for k in range(8):
                counts[8 * k:8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by ``fingerprint`` (a signed long, one
    row per row; null text counts as empty)."""
    keep = [c for c in docs.columns if c not in (text, "fingerprint")]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(0).cast("long").alias("fingerprint")).schema

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t, shingle, seed) for t in texts_of(b.column(text))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got)], [*keep, "fingerprint"])

    return docs.mapInArrow(run, schema)


def group_masks(r: int) -> list[int]:
    """Bit masks of the r groups: bit b is in group b mod r."""
    return [sum(1 << b for b in range(k, BITS, r)) for k in range(r)]


def _buckets(values: np.ndarray, masks: list[int]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    for k, m in enumerate(masks):
        out |= (np.bitwise_count(values & np.uint64(m)).astype(np.int64) & 1) << k
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable node for nodes 0..n-1 under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new


def bucket_links(prints: np.ndarray, bucket: int, r: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest linked one) among the fingerprints that
    have variants in ``bucket``."""
    high, low = (max_bits + 1) // 2, max_bits // 2
    masks = group_masks(r)
    ball = flips(BITS, high)
    syndrome = _buckets(ball, masks)
    by = np.argsort(syndrome, kind="stable")
    ball, syndrome = ball[by], syndrome[by]
    away = _buckets(prints, masks) ^ bucket
    lo, hi = np.searchsorted(syndrome, away), np.searchsorted(syndrome, away, side="right")
    total = int((hi - lo).sum())
    slices = max(1, math.ceil(total / SLICE_VARIANTS))
    order = np.argsort(lo, kind="stable")        # fingerprints with the same masks side by side
    cuts = np.flatnonzero(np.diff(lo[order], prepend=-1))
    groups = [(order[i:j], ball[lo[order[i]]:hi[order[i]]]) for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)]

    def variants(s: int):
        """(fingerprint's place, variant) in the slice, in bounded pieces."""
        for own, flip in groups:
            if not len(flip):
                continue
            step = max(1, (1 << 20) // len(flip))
            for i in range(0, len(own), step):
                v = (prints[own[i:i + step], None] ^ flip).ravel()
                at = np.repeat(own[i:i + step], len(flip))
                if slices > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices) == s
                    v, at = v[mine], at[mine]
                yield at, v

    a, b = [], []
    for s in range(slices):
        every = np.sort(np.concatenate([v for _, v in variants(s)] or [np.zeros(0, dtype=np.uint64)]))
        met = every[1:][every[1:] == every[:-1]]
        met = met[np.append(True, met[1:] != met[:-1])] if len(met) else met
        del every
        if not len(met):
            continue
        who, where = [], []
        for at, v in variants(s):
            k = np.searchsorted(met, v)
            k[k == len(met)] = 0
            ok = met[k] == v
            who.append(at[ok])
            where.append(k[ok])
        who, where = np.concatenate(who), np.concatenate(where)
        near = np.bitwise_count(prints[who] ^ met[where]) <= low
        by = np.lexsort((prints[who], ~near, where))    # per variant: near ones first
        who, where, near = who[by], where[by], near[by]
        lead = np.flatnonzero(np.diff(where, prepend=-1))
        centre = np.repeat(lead, np.diff(np.append(lead, len(where))))
        x, y = who, who[centre]
        fine = near[centre] & (x != y) & (np.bitwise_count(prints[x] ^ prints[y]) <= max_bits)
        a.append(x[fine])
        b.append(y[fine])
    if not a:
        return prints[:0], prints[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    signed = prints.view(np.int64)
    order = np.argsort(signed, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    root = local_roots(place[a], place[b], len(prints))
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return signed[order[moved]], signed[order[root[moved]]]


def links(prints: DataFrame, max_bits: int = 4, count: int | None = None) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (one long column
    ``fingerprint``) at ``max_bits`` or fewer bits into their components."""
    n = prints.count() if count is None else count
    ball = len(flips(BITS, (max_bits + 1) // 2))
    r = min(BITS, max(0, math.ceil(math.log2(max(1, n * ball / BUCKET_VARIANTS)))))
    masks = group_masks(r)
    home = sum(((F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(_signed(m)))) % 2).cast("long") * (1 << k) for k, m in enumerate(masks)), F.lit(0).cast("long"))
    reach = F.array(*(F.lit(x).cast("long") for x in flips(r, min(r, (max_bits + 1) // 2)).astype(np.int64).tolist()))
    sent = prints.select("fingerprint", F.explode(reach).alias("flip"), home.alias("home")).select("fingerprint", F.col("home").bitwiseXOR(F.col("flip")).alias("bucket"))

    def run(group: pa.Table) -> pa.Table:
        x = group.column("fingerprint").to_numpy().view(np.uint64)
        a, b = bucket_links(x, group.column("bucket")[0].as_py(), r, max_bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("bucket").applyInArrow(run, "a long, b long")


def _classes(docs: DataFrame, shingle: int, max_bits: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint) of every row, and (fingerprint, root, component_id)
    of every distinct fingerprint, both as written tables."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(fingerprints(slim, shingle, seed), "simhash-prints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")), "simhash-nodes")
    roots = components(links(nodes.select("fingerprint"), max_bits), "simhash-links")
    roots = written(nodes.join(roots, nodes.fingerprint == roots.node, "left").select("fingerprint", "first_doc", F.coalesce("root", "fingerprint").alias("root")), "simhash-roots")
    lowest = roots.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return prints, roots.join(lowest, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of
    ``docs``: the smallest doc_id among documents reachable over links of
    ``max_bits`` or fewer differing bits.

    A null text counts as empty; texts without a word have fingerprint zero and
    are linked like any other. Repeated rows come out repeated; a null doc_id
    takes part but is never the smallest (component_id is null if there is no
    other). An empty table gives an empty one.
    """
    prints, classes = _classes(docs, shingle, max_bits, seed)
    out = prints.join(classes, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (of
    several rows with this doc_id in the component, the one whose text has the
    smallest hash). Of a component without any doc_id one row stays, by the same
    rule. Columns as they were."""
    prints, classes = _classes(docs, shingle, max_bits, seed)
    classes = written(classes, "simhash-classes")
    first = classes.select(F.col("component_id").alias("first")).where("first is not null").distinct()
    kept = docs.join(first, docs["doc_id"].cast("long") == first["first"], "left_semi")
    # rows that share a doc_id may lie in several components: only these are dealt by fingerprint
    twice = written(prints.where("doc_id is not null").groupBy(F.col("doc_id").alias("twice")).count().where("count > 1").select("twice"), "simhash-twice")
    once = kept.join(twice, kept["doc_id"].cast("long") == twice["twice"], "left_anti")
    again = kept.join(twice, kept["doc_id"].cast("long") == twice["twice"], "left_semi").unionByName(docs.where("doc_id is null"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    again = fingerprints(again.select(row, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), shingle, seed)
    again = again.join(classes, "fingerprint").where(F.col("component_id").eqNullSafe(F.col("id")))
    order = F.struct(F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))), F.xxhash64(F.to_json("row")))
    again = again.groupBy("root").agg(F.min_by("row", order).alias("row")).select("row.*")
    return once.unionByName(again)
