"""Approximate nearest neighbours by cross-polytope hashing (operator 12).

A vector's direction is turned by three rounds of random signs and a fast
Hadamard transform and goes to the nearest signed axis; ``parts`` such axes make
its bucket in a table. Rows lie once in each table, queries probe many buckets
there (the axes nearest to them, by the squared distance to their own), and what
they meet is reranked by exact Euclidean distance in double precision.

``parts`` and the number of probes are fitted on a bounded sample (SAMPLE rows,
SAMPLE_QUERIES of them as queries, searched exhaustively): the cheapest setting
that finds the share ``target`` of the sample's true neighbours. Neighbours in
the whole table are nearer than in the sample, so they are found more often. The
sample also gives each query a first bound (the distance of its k-th nearest
sampled row) and tells which buckets are hot. Every row is indexed.

Hot groups: equal vectors are one class with its k + 1 smallest ids (that many
can be in a result), cut by a partial limit before the shuffle; equal queries
are searched once. Buckets with more than BLOCK rows or QUERY_BLOCK queries are
salted on both sides. A task reads a bucket's queries, then its rows as a
stream, and hands on at most k + 1 rows a query.

Queries with fewer than k found rows are searched against all rows, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id; a repeated id counts once,
with the vector of the smallest hash; vectors of different lengths aren't
compared; fewer than k candidates give fewer rows, an empty table none; further
columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, SAMPLE_QUERIES = 4096, 256
MAX_PROBES = 2048
PROBE_COST = 64          # rows compared in the time of one more probe
BLOCK, QUERY_BLOCK = 16384, 16384
SEARCH_BLOCK = 1024      # queries of a block of the exhaustive search
PAIRS = 1 << 22          # distances computed at once
SLACK = 1e-9

_FOUND = "h1 long, h2 long, score double, id long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix (a power of two wide)."""
    width, half = x.shape[1], 1
    x = x.copy()
    while half < width:
        y = x.reshape(len(x), width // (2 * half), 2, half)
        low = y[:, :, 0].copy()
        y[:, :, 0] += y[:, :, 1]
        y[:, :, 1] = low - y[:, :, 1]
        half *= 2
    return x / math.sqrt(width)


class Hash:
    """The tables of vectors of one length; equal on every task by its seed."""

    def __init__(self, length: int, tables: int, parts: int, probes: int, seed: int = 42):
        self.length, self.tables, self.parts, self.probes = length, tables, parts, probes
        self.width = max(1, 1 << (length - 1).bit_length())
        self.axes = 2 * self.width
        self.signs = np.random.default_rng([seed, length]).choice([-1.0, 1.0], (tables, 3, 3, self.width))

    def turned(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each part the coordinates on all signed axes."""
        unit = np.zeros((len(x), self.width))
        largest = np.abs(x).max(axis=1, keepdims=True)
        scaled = x / largest                       # no overflow of squares
        unit[:, :self.length] = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        out = []
        for part in range(self.parts):
            y = unit
            for signs in self.signs[table, part]:
                y = hadamard(y * signs)
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for y in self.turned(x, table):
            code = code * self.axes + y.argmax(axis=1)
        return code

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """Each row's first ``probes`` buckets, nearest first (fewer if there are no more)."""
        return np.concatenate([self._probed(x[a:a + 256], table) for a in range(0, max(1, len(x)), 256)])

    def _probed(self, x: np.ndarray, table: int) -> np.ndarray:
        codes = costs = None
        for y in self.turned(x, table):
            order = np.argsort(-y, axis=1, kind="stable")[:, :self.probes]
            value = np.take_along_axis(y, order, 1)
            cost = (value[:, :1] - value) ** 2
            if codes is not None:
                # both lists are sorted: (i, j) has (i + 1)(j + 1) - 1 pairs before it
                i, j = np.nonzero(np.arange(1, codes.shape[1] + 1)[:, None] * np.arange(1, order.shape[1] + 1)[None, :] <= self.probes)
                order, cost = codes[:, i] * self.axes + order[:, j], costs[:, i] + cost[:, j]
                best = np.argsort(cost, axis=1, kind="stable")[:, :self.probes]
                order, cost = np.take_along_axis(order, best, 1), np.take_along_axis(cost, best, 1)
            codes, costs = order, cost
        return codes


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances of equally many queries and rows."""
    gap = queries - rows
    return np.sqrt((gap * gap).sum(axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _near(queries: np.ndarray, bounds: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, exact distance) of the rows that can be among a query's k
    nearest of these and within its bound. Products only narrow the choice, with
    room for their rounding."""
    squares, step = (rows * rows).sum(axis=1), max(1, PAIRS // max(1, len(rows)))
    for a in range(0, len(queries), step):
        part = queries[a:a + step]
        own = (part * part).sum(axis=1)
        with np.errstate(all="ignore"):
            about = own[:, None] + squares[None, :] - 2.0 * (part @ rows.T)
            room = SLACK * (own[:, None] + squares[None, :])
            low = about - room
            limit = bounds[a:a + step] ** 2 * (1 + SLACK)
            if len(rows) > k:
                limit = np.minimum(limit, np.partition(about + room, k - 1, axis=1)[:, k - 1])
            q, r = np.nonzero(~(low > limit[:, None]))     # what overflows stays
        yield q + a, r, exact(part[q], rows[r])


class _Best:
    """The k nearest ids of each query so far; an id counts once."""

    def __init__(self, k: int):
        self.k = k
        self.held = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, q: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((q, distance, ids))
        self.size += len(q)
        if self.size > max(200_000, 2 * len(self.held[0])):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, i = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((d, i, q))
        q, d, i = q[order], d[order], i[order]
        first = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])] if len(q) else np.zeros(0, dtype=bool)
        q, d, i = q[first], d[first], i[first]
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < self.k
        self.held, self.new, self.size = (q[keep], d[keep], i[keep]), [], 0
        return self.held


def _ids_of(column: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chosen rows of a list column: how many values each has, and the values."""
    ends = column.offsets.to_numpy().astype(np.int64)
    ends, values = ends - ends[0], column.flatten().to_numpy(zero_copy_only=False)
    sizes = ends[rows + 1] - ends[rows]
    return sizes, values[np.repeat(ends[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]


# ---- rows, classes of equal vectors --------------------------------------------

def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, h1, h2) of the rows that take part; h1 and h2 name the vector."""
    x = F.col("x")
    kind = dict(table.dtypes)[vector_col]
    x_in = F.col(f"`{vector_col}`")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), (x_in if kind in ("array<float>", "array<double>") else x_in.cast("array<double>")).alias("x"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull()).filter(finite & F.exists(x, lambda v: v != 0))
    return rows.select("id", "x", F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), F.size(x), x).alias("h2"))


def classes_of(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The ids with their class, and the classes: (h1, h2, x, ids) with the
    ``keep`` smallest ids of each."""
    members = rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    members = written(members, "ann-members")
    by = Window.partitionBy("h1", "h2").orderBy("id")
    first = members.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= keep)
    first = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    x = rows.groupBy("h1", "h2").agg(F.first("x").alias("x"))
    return members, x.join(first, ["h1", "h2"])


# ---- fit ------------------------------------------------------------------------

class Fit:
    """What a sample of one length of vectors tells: the hash, the sample itself
    and the salts of hot buckets."""

    def __init__(self, sample: np.ndarray, n_rows: int, n_queries: int, k: int, tables: int, target: float):
        self.sample, self.k = sample, k
        chosen = np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int)
        true = np.zeros((len(chosen), len(sample)), dtype=bool)
        for i, q in enumerate(chosen):
            away = exact(sample[q][None, :], sample)
            away[q] = np.inf
            true[i, np.argsort(away, kind="stable")[:min(k, len(sample) - 1)]] = True
        best = None
        for parts in (1, 2, 3):
            trial = Hash(sample.shape[1], tables, parts, 2 * (1 << (sample.shape[1] - 1).bit_length()) if parts == 1 else MAX_PROBES)
            ranks = np.full((tables, len(chosen), len(sample)), np.iinfo(np.int64).max)
            for table in range(tables):
                own, probed = trial.buckets(sample, table), trial.probed(sample[chosen], table)
                for i, codes in enumerate(probed):
                    order = np.argsort(codes, kind="stable")
                    at = np.minimum(np.searchsorted(codes[order], own), len(codes) - 1)
                    hit = codes[order][at] == own
                    ranks[table, i, hit] = order[at][hit]
            first = np.sort(ranks.min(axis=0)[true])
            if not len(first):
                best = best or (0.0, parts, 1)
                continue
            probes = int(min(first[math.ceil(target * len(first)) - 1], np.iinfo(np.int64).max - 1)) + 1
            if probes > probed.shape[1]:
                break       # with more parts a neighbour is no nearer to the front
            cost = tables * probes * PROBE_COST + n_rows * float((ranks < probes).mean()) * tables
            if best is None or cost < best[0]:
                best = (cost, parts, probes)
        self.hash = Hash(sample.shape[1], tables, *best[1:])
        self.salts: list[dict[int, tuple[int, int]]] = []
        for table in range(tables):
            rows = dict(zip(*(a.tolist() for a in np.unique(self.hash.buckets(sample, table), return_counts=True)), strict=True))
            asks = dict(zip(*(a.tolist() for a in np.unique(self.hash.probed(sample[chosen], table), return_counts=True)), strict=True))
            split = {b: (math.ceil(rows.get(b, 0) / len(sample) * n_rows / BLOCK) or 1, math.ceil(asks.get(b, 0) / len(chosen) * n_queries / QUERY_BLOCK) or 1) for b in {*rows, *asks}}
            self.salts.append({b: s for b, s in split.items() if s != (1, 1)})

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The distance of each query's k + 1 nearest sampled vectors: no farther row can be in its result."""
        out = np.full(len(queries), np.inf)
        if len(self.sample) > self.k:
            for i, q in enumerate(queries):
                out[i] = np.partition(exact(q[None, :], self.sample), self.k)[self.k]
        return out


def fitted(classes: DataFrame, n_queries: int, k: int, tables: int, target: float) -> dict[int, Fit]:
    """A fit per length of vectors, each on at most SAMPLE classes (those of the
    smallest hashes)."""
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for length, n in sizes.items():
        share = min(1.0, SAMPLE / n)
        own = classes.filter((F.size("x") == length) & (F.pmod("h1", F.lit(1 << 30)) <= int(min(1.0, 2 * share) * (1 << 30)))).select(F.pmod("h1", F.lit(1 << 30)).alias("o"), "h1", "h2", "x")
        rows = own.orderBy("o", "h1", "h2").limit(SAMPLE).collect()
        if rows:
            out[length] = Fit(np.array([r["x"] for r in rows], dtype=np.float64), n, n_queries, k, tables, target)
    return out


# ---- index and search -------------------------------------------------------------

def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch's rows by the length of their vectors."""
    lengths = np.diff(batch.column(column).offsets.to_numpy()) if batch.num_rows else np.zeros(0, dtype=int)
    for length in np.unique(lengths).tolist():
        yield length, batch.take(pa.array(np.flatnonzero(lengths == length)))


def _placed(fits: dict[int, Fit], asking: bool):
    """Rows once in each table, queries in every bucket they probe; a bucket's
    name holds table and vector length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for length, batch in _by_length(whole, 2):
                if length not in fits:
                    continue
                fit, x = fits[length], _matrix(batch.column(2))
                deal = batch.column(0).to_numpy() >> 8
                bounds = fit.bounds(x) if asking else np.zeros(len(x))
                for table, salts in enumerate(fit.salts):
                    codes = fit.hash.probed(x, table) if asking else fit.hash.buckets(x, table)[:, None]
                    step = max(1, 20_000 // codes.shape[1])
                    for a in range(0, len(x), step):
                        part = codes[a:a + step]
                        at, code, salt = np.repeat(np.arange(a, a + len(part)), part.shape[1]), part.ravel(), np.zeros(part.size, dtype=np.int64)
                        hot = np.flatnonzero(np.isin(code, np.fromiter(salts, dtype=np.int64, count=len(salts)))) if salts else []
                        if len(hot):
                            more_at, more_code, more_salt = [], [], []
                            for i in hot:
                                rows, asks = salts[int(code[i])]
                                mine = [s * asks + int(deal[at[i]] % asks) for s in range(rows)] if asking else [int(deal[at[i]] % rows) * asks + s for s in range(asks)]
                                more_at += [at[i]] * len(mine)
                                more_code += [code[i]] * len(mine)
                                more_salt += mine
                            at, code, salt = (np.concatenate([np.delete(old, hot), np.array(new, dtype=np.int64)]) for old, new in ((at, more_at), (code, more_code), (salt, more_salt)))
                        pick = pa.array(at)
                        name = (code * len(fit.salts) + table) * 65536 + length % 65536
                        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(salt, pa.int32()), pa.array(np.full(len(at), 0 if asking else 1), pa.int8()),
                                                          *(batch.column(c).take(pick) for c in range(4)), pa.array(bounds[at])],
                                                         ["bucket", "salt", "kind", "h1", "h2", "x", "ids", "bound"])
    return run


def _scan(k: int):
    """Buckets of a partition in order, queries before rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[int, int], int] = {}
        names: list[tuple[int, int]] = []
        best, here, asked, bound, own = _Best(k), None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, salt, kind = (batch.column(c).to_numpy() for c in range(3))
            length = np.diff(batch.column(5).offsets.to_numpy())
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1]) | (length[1:] != length[:-1])) + 1
            for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)], strict=True):
                part, at = batch.slice(a, z - a), (bucket[a], salt[a], length[a])
                if at != here:
                    here, asked, bound, own = at, [], [], []
                x = _matrix(part.column(5))
                if kind[a] == 0:
                    asked.append(x)
                    bound.append(part.column(7).to_numpy())
                    for name in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                        if name not in numbers:
                            numbers[name] = len(names)
                            names.append(name)
                        own.append(numbers[name])
                elif asked:
                    if len(asked) > 1:
                        asked, bound = [np.concatenate(asked)], [np.concatenate(bound)]
                    mine = np.array(own, dtype=np.int64)
                    for q, r, away in _near(asked[0], bound[0], x, k):
                        sizes, ids = _ids_of(part.column(6), r)
                        best.add(np.repeat(mine[q], sizes), np.repeat(away, sizes), ids)
        q, away, ids = best.cut()
        if len(q):
            name = np.array(names, dtype=np.int64)[q]
            yield pa.RecordBatch.from_arrays([pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(away), pa.array(ids)], ["h1", "h2", "score", "id"])
    return run


def _against_all(names: list[tuple[int, int]], queries: np.ndarray, k: int):
    """A block of queries against all rows of their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bound = _Best(k), np.full(len(queries), np.inf)
        for whole in batches:
            for length, batch in _by_length(whole, 2):
                if length == queries.shape[1]:
                    for q, r, away in _near(queries, bound, _matrix(batch.column(2)), k):
                        sizes, ids = _ids_of(batch.column(3), r)
                        best.add(np.repeat(q, sizes), np.repeat(away, sizes), ids)
        q, away, ids = best.cut()
        if len(q):
            name = np.array(names, dtype=np.int64)[q]
            yield pa.RecordBatch.from_arrays([pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(away), pa.array(ids)], ["h1", "h2", "score", "id"])
    return run


def _nearest_ids(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("h1", "h2").orderBy("score", "id")
    return found.dropDuplicates(["h1", "h2", "id"]).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).drop("place")


def _blocks(rows: DataFrame) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Query classes in blocks of one length and at most SEARCH_BLOCK."""
    names, xs = [], []
    for row in rows.orderBy(F.size("x"), "h1", "h2").select("h1", "h2", "x").toLocalIterator():
        if names and (len(names) >= SEARCH_BLOCK or len(row["x"]) != len(xs[0])):
            yield names, np.array(xs, dtype=np.float64)
            names, xs = [], []
        names.append((row["h1"], row["h2"]))
        xs.append(row["x"])
    if names:
        yield names, np.array(xs, dtype=np.float64)


def nearest(table: DataFrame, every: int = 100, k: int = 10, tables: int = 2, target: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` the
    ``k`` nearest other ids that were found, ties by the smaller id."""
    rows = vectors_of(table, id_col, vector_col)
    members, classes = classes_of(rows, k + 1)
    classes = written(classes, "ann-classes")
    asking = members.filter(F.col("id") % every == 0)
    asked = written(classes.join(asking.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "x", "ids"), "ann-queries")
    shape = "bucket long, salt int, kind byte, h1 long, h2 long, x array<%s>, ids array<long>, bound double" % ("float" if "float" in dict(classes.dtypes)["x"] else "double")
    fits = fitted(classes, asked.count(), k, tables, target)
    placed = classes.select("h1", "h2", "x", "ids").mapInArrow(_placed(fits, False), shape).unionByName(asked.mapInArrow(_placed(fits, True), shape))
    met = placed.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(_scan(k + 1), _FOUND)
    found = written(_nearest_ids(met, k + 1), "ann-found")
    # too few: all of them, unless the table has no more rows of that length
    had = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(classes.groupBy(F.size("x").alias("d")).agg(F.sum(F.size("ids")).alias("rows")))      # a row per length
    short = asked.join(had, ["h1", "h2"], "left").join(sizes, F.size("x") == F.col("d")).filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(k + 1), F.col("rows")))
    short = written(short.select("h1", "h2", "x"), "ann-short")
    for names, queries in _blocks(short):
        more = classes.select("h1", "h2", "x", "ids").mapInArrow(_against_all(names, queries, k + 1), _FOUND)
        found = found.unionByName(_nearest_ids(more, k + 1))
    pairs = asking.withColumnRenamed("id", "query_id").join(found, ["h1", "h2"]).filter(F.col("id") != F.col("query_id")).groupBy("query_id", "id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "id")
    return pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
