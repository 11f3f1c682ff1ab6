"""Ranked lexical search by LEMP-style norm buckets (operator 13).

A document is a vector of integer impacts over the query terms, a query a
vector of integer term weights; the score is their product. Both sides carry
the square root of the weight, which leaves the product and evens the lengths.
Documents are ordered by the length of their vectors (a range sort, ties dealt
by a hash) and read in buckets of BUCKET neighbours. For a query with the
threshold t (the score of its k-th best so far):

* Cauchy-Schwarz prunes a bucket: |query| * longest < t, so no row can reach t;
* coordinate bounds filter inside: the FOCUS largest coordinates of the query
  are multiplied exactly, by the postings of the bucket, and the rest is at most
  |rest of the query| * sqrt(|row|^2 - focus^2);
* survivors are rescored exactly in 64-bit integers.

Thresholds start from a share of the rows, searched first (that only sets how
much is pruned: every row is searched, and a bound is widened by more than its
rounding), and rise inside a task. A task hands on at most k rows a query.

Queries come to the driver in blocks of at most BLOCK_CELLS items x terms; each
block is a search of all documents. An item of more terms than that is a block
of its own, so one item's distinct terms must fit in a task.

Defined results: a null text or item has no terms (no rows), a null doc_id or
item_id counts as an id like any other (null doc_ids come last among ties),
rows of one item_id form one item together, a repeated document row is a
document of its own, an empty table gives no rows, further columns are ignored.
A very long text is counted by its distinct terms.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD_TABLE, texts_of, written

BLOCK_CELLS = 1 << 22     # items x terms of a block: its dense weights take 32 MB
BUCKET = 1024
FOCUS = 6
SEED_SHARE, SEED_ROWS = 1 / 16, 8192    # rows searched first: this share, but that many at least
SLACK = 1e-9                            # relative widening of a bound


def _terms(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(set(_terms(t))) for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has any."""
    kind = benchmark.schema["item_id"].dataType
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_item_terms, T.StructType([T.StructField("item_id", kind), T.StructField("terms", T.ArrayType(T.BinaryType()))]))
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of bounded size, one partition at a time on the driver."""
    block, pairs = [], 0
    for row in items.toLocalIterator():
        if block and (pairs + len(row.terms)) * (len(block) + 1) > BLOCK_CELLS:
            yield block
            block, pairs = [], 0
        block.append((row.item_id, [bytes(t) for t in row.terms]))
        pairs += len(row.terms)
    if block:
        yield block


def _counted(vocabulary: list[bytes]):
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.keys()
        for batch in batches:
            ns, terms, tfs, ends = [], [], [], [0]
            for text in texts_of(batch.column(1)):
                words = _terms(text)
                counts = Counter(words)
                own = sorted((number[t], counts[t]) for t in counts.keys() & known)
                ns.append(len(words))
                terms += [t for t, _ in own]
                tfs += [n for _, n in own]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document all its terms with repeats (n) and its counts of the
    vocabulary's terms."""
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted(vocabulary), out)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of a list column without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def _impacts(n_docs: int, n_terms: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, terms = _flat(batch.column(2))
            _, tfs = _flat(batch.column(3))
            m = np.array([50 + (50 * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)   # Python's integers can't overflow
            impacts = (1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(m, np.diff(ends)))
            squares = weights[terms] * impacts.astype(np.float64) ** 2
            lengths = np.sqrt(np.bincount(np.repeat(np.arange(len(m)), np.diff(ends)), squares, len(m)))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(offsets, pa.array(impacts, pa.int64())), batch.column(4)], ["doc_id", "length", "terms", "impacts", "spread"])
    return run


class _Queries:
    """A block of queries: dense integer weights, and per query its largest
    coordinates (focus) and the length of the rest."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray):
        self.weights = np.zeros((len(queries), len(weights)), dtype=np.int64)
        self.length, self.rest = np.zeros(len(queries)), np.zeros(len(queries))
        pairs = []
        for q, terms in enumerate(queries):
            self.weights[q, terms] = weights[terms]
            order = terms[np.argsort(-weights[terms], kind="stable")]
            self.length[q], self.rest[q] = np.sqrt(weights[order].sum()), np.sqrt(weights[order[FOCUS:]].sum())
            pairs += [(q, t) for t in order[:FOCUS]]
        self.focus = np.array(pairs, dtype=np.int64).reshape(-1, 2)


def _bucket_scores(queries: _Queries, weights: np.ndarray, least: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows of the bucket, their exact scores) of all rows that can reach ``least`` (1 or more)."""
    rows = len(lengths)
    open_ = queries.length * lengths.max(initial=0.0) * (1 + SLACK) >= least        # Cauchy-Schwarz for the bucket
    if not open_.any():
        return
    of_row = np.repeat(np.arange(rows), np.diff(ends))
    by_term = np.argsort(terms, kind="stable")
    starts = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
    live = np.flatnonzero(open_)
    place = np.full(len(open_), -1)
    place[live] = np.arange(len(live))
    focus = queries.focus[open_[queries.focus[:, 0]]]
    sizes = starts[focus[:, 1] + 1] - starts[focus[:, 1]]
    at = by_term[np.repeat(starts[focus[:, 1]], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    cell = place[np.repeat(focus[:, 0], sizes)] * rows + of_row[at]
    value, weight = impacts[at].astype(np.float64), weights[terms[at]]
    exact = np.bincount(cell, weight * value, len(live) * rows).reshape(len(live), rows)
    square = np.bincount(cell, weight * value * value, len(live) * rows).reshape(len(live), rows)
    left = np.sqrt(np.maximum(lengths[None, :] ** 2 * (1 + SLACK) - square, 0.0))
    may = (exact + queries.rest[live, None] * left) * (1 + SLACK) >= least[live, None]
    for j, q in enumerate(live):
        hit = np.flatnonzero(may[j])
        if not len(hit):
            continue
        sizes = ends[hit + 1] - ends[hit]
        at = np.repeat(ends[hit], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sums = np.concatenate([[0], np.cumsum(queries.weights[q][terms[at]] * impacts[at])])
        stop = np.cumsum(sizes)
        scores = sums[stop] - sums[stop - sizes]
        keep = scores >= least[q]
        if keep.any():
            yield int(q), hit[keep], scores[keep]


def _search(query_terms: list[np.ndarray], weights: np.ndarray, thresholds: np.ndarray, k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floats = _Queries(query_terms, weights), weights.astype(np.float64)
        least = np.maximum(thresholds, 1)
        best: list[list[tuple]] = [[] for _ in query_terms]

        def cut(q: int) -> None:
            best[q].sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
            del best[q][k:]
            if len(best[q]) == k:
                least[q] = max(least[q], best[q][-1][0])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ends, terms = _flat(batch.column(2))
            _, impacts = _flat(batch.column(3))
            for a in range(0, len(ids), BUCKET):
                z = min(a + BUCKET, len(ids))
                part = slice(ends[a], ends[z])
                for q, rows, scores in _bucket_scores(queries, floats, least, ends[a:z + 1] - ends[a], terms[part], impacts[part], lengths[a:z]):
                    best[q] += [(s, ids[a + r]) for r, s in zip(rows.tolist(), scores.tolist(), strict=True)]
                    if len(best[q]) >= 2 * k:
                        cut(q)
        for q in range(len(best)):
            cut(q)
        found = [(q, *x) for q, rows in enumerate(best) for x in rows]
        if found:
            query, score, ids = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, id_type), pa.array(score, pa.int64())], ["query", "doc_id", "score"])
    return run


def _top(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_ranked(docs: DataFrame, block: list[tuple[object, list[bytes]]], item_type: T.DataType, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = [np.array([number[t] for t in terms], dtype=np.int64) for _, terms in block]
    counts = written(term_counts(docs, vocabulary).withColumn("spread", F.xxhash64("doc_id", F.monotonically_increasing_id())), "lexical-counts")
    n_docs, n_terms = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a row per term of the block's bounded vocabulary
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row["term"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    kind = docs.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("doc_id", kind), T.StructField("length", T.DoubleType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                          T.StructField("impacts", T.ArrayType(T.LongType())), T.StructField("spread", T.LongType())])
    vectors = counts.filter(F.size("terms") > 0).mapInArrow(_impacts(n_docs, max(1, n_terms), weights.astype(np.float64)), shape)
    ordered = written(vectors.repartitionByRange(F.col("length").desc(), F.col("spread")).sortWithinPartitions(F.col("length").desc(), F.col("spread")), "lexical-vectors")
    out = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    ids = to_arrow_type(kind)
    cut = int(min(1.0, max(SEED_SHARE, SEED_ROWS / max(1, n_docs))) * (1 << 20))
    seeds = ordered.filter(F.pmod("spread", F.lit(1 << 20)) < cut).mapInArrow(_search(queries, weights, np.zeros(len(block), dtype=np.int64), k, ids), out)
    thresholds = np.zeros(len(block), dtype=np.int64)
    for row in _top(seeds, "query", k).filter(F.col("rank") == k).collect():       # a row per query of the block
        thresholds[row["query"]] = row["score"]
    found = _top(ordered.mapInArrow(_search(queries, weights, thresholds, k, ids), out), "query", k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item_type)]))
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, benchmark: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score
    above 0 for each item, ties by doc_id."""
    kind = benchmark.schema["item_id"].dataType
    parts = [_block_ranked(docs, block, kind, k) for block in blocks(items_of(benchmark))]
    if not parts:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
                                                                   T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
