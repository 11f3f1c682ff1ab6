"""Deterministic sampling, balancing and folds.

All choices come from an md5 hash of (row key, seed, salt), so results do
not depend on partitioning and are stable under task retries.

Exact per-class ranking without a global or per-class window
("histogram cut"): rows are bucketed by the leading hex digits of their
hash; bucket counts per class form a small table whose cumulative sums give
each bucket's offset; a row's rank is its bucket offset plus its rank inside
the (class, bucket) partition. The prefix length is chosen from the largest
class so that no bucket holds more than ``max_bucket_rows`` rows, which keeps
every window partition bounded even when one class holds a third of the data.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import hashing as hz
from .monitor import join_null_safe


def sort_hash(key, seed=42, salt="") -> Column:
    return F.md5(hz.hash_key(key, seed, salt))


def _prefix_len(max_class_rows: int, max_bucket_rows: int) -> int:
    if max_class_rows <= max_bucket_rows:
        return 1
    return min(12, 1 + math.ceil(math.log(max_class_rows / max_bucket_rows, 16)))


def class_ranked(df: DataFrame, label_col: str, key_col: str, seed=42, salt="",
                 max_bucket_rows: int = 2_000_000) -> DataFrame:
    """Adds ``_h`` (hash order key), ``_rank`` (1-based rank by ``_h``, then
    key, inside the class) and ``_n`` (class size). Rows without a label are a
    class of their own."""
    h = df.withColumn("_h", sort_hash(F.col(key_col), seed, salt))
    counts = h.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    biggest = counts.agg(F.max("_n")).first()[0] or 0
    p = _prefix_len(int(biggest), max_bucket_rows)
    h = h.withColumn("_b", F.substring("_h", 1, p))
    buckets = h.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    # Window over the bucket table (classes x 16^p rows), not over the data.
    w = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(label_col, "_b", F.coalesce(F.sum("_bn").over(w), F.lit(0)).alias("_off"))
    offsets = join_null_safe(offsets, counts, [label_col])
    inner = Window.partitionBy(label_col, "_b").orderBy("_h", key_col)
    # The offset table has (classes x 16^p) rows; broadcast it only when that
    # bound is small, else it takes the shuffle path.
    n_classes = counts.count()
    small = n_classes * (16 ** p) <= 100_000     # rows of a few dozen bytes
    ranked = (join_null_safe(h, F.broadcast(offsets) if small else offsets, [label_col, "_b"])
                .withColumn("_rank", F.col("_off") + F.row_number().over(inner)))
    return ranked.drop("_b", "_off")


def stratified_split(df: DataFrame, label_col: str = "label", key_col: str = "doc_id",
                     test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """B1: adds ``split`` = 'test' for the first round(test_size * n_class)
    rows of each class in hash order, else 'train'."""
    r = class_ranked(df, label_col, key_col, seed, "split")
    test = F.col("_rank") <= F.round(F.col("_n") * F.lit(test_size))
    return r.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_rank", "_n")


def undersample(df: DataFrame, label_col: str = "label", key_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """B2: every class cut to the smallest class size."""
    r = class_ranked(df, label_col, key_col, seed, "under")
    smallest = r.agg(F.min("_n")).first()[0]
    return r.filter(F.col("_rank") <= F.lit(smallest)).drop("_h", "_rank", "_n")


def quota_sample(df: DataFrame, quotas: dict, label_col: str = "label", key_col: str = "doc_id",
                 seed: int = 42) -> DataFrame:
    """Per-class quota in one pass; a class shorter than its quota is
    kept whole; classes without a quota are dropped."""
    q = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    r = class_ranked(df, label_col, key_col, seed, "quota")
    return r.filter(F.col("_rank") <= F.coalesce(F.element_at(q, F.col(label_col)), F.lit(0))).drop("_h", "_rank", "_n")


def oversample(df: DataFrame, label_col: str = "label", key_col: str = "doc_id", seed: int = 42,
               chunk: int = 1_000_000) -> DataFrame:
    """Originals plus (max - n_class) draws with replacement per class.

    Draw i of a class picks rank floor(u01(class, i) * n) + 1. Draw ids are
    generated in chunks of ``chunk`` spread over tasks (never one task per
    class), then equi-joined to the ranked rows on (class, rank). Output has
    ``draw`` = 0 for originals."""
    r = class_ranked(df, label_col, key_col, seed, "over")
    counts = r.groupBy(label_col).agg(F.first("_n").alias("_n"))
    biggest = F.max("_n").over(Window.partitionBy())
    need = counts.select(label_col, "_n", (biggest - F.col("_n")).alias("_need"))
    n_chunks = F.ceil(F.col("_need") / F.lit(chunk)).cast("long")
    empty = F.array().cast("array<long>")
    chunks = need.select(label_col, "_n", "_need", F.explode(
        F.when(n_chunks > 0, F.sequence(F.lit(0).cast("long"), n_chunks - 1, F.lit(1).cast("long"))).otherwise(empty)).alias("_c"))
    chunks = chunks.repartition(label_col, "_c")
    lo = F.col("_c") * chunk + 1
    hi = F.least((F.col("_c") + 1) * chunk, F.col("_need"))
    draws = chunks.select(label_col, "_n", F.explode(
        F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long"), F.lit(1).cast("long"))).otherwise(empty)).alias("draw"))
    draws = draws.withColumn("_rank", (F.floor(hz.u01(F.col(label_col), seed, "draw", F.col("draw")) * F.col("_n")) + 1).cast("long"))
    cols = [c for c in df.columns]
    extra = join_null_safe(draws, r.select(label_col, "_rank", *[c for c in cols if c != label_col]), [label_col, "_rank"])
    orig = r.select(*cols, F.lit(0).cast("int").alias("draw"))
    return orig.unionByName(extra.select(*cols, F.col("draw").cast("int")))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """weight = n / (k * n_class), joined back (the class table is as long
    as there are labels, so adaptive execution decides on a broadcast)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.select(label_col, (F.sum("_nc").over(Window.partitionBy()) /
                                    (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_nc"))).alias("weight"))
    return join_null_safe(df, tot, [label_col])


def stratified_folds(df: DataFrame, k: int = 5, label_col: str = "label", key_col: str = "doc_id",
                     seed: int = 42) -> DataFrame:
    """fold = (rank - 1) mod k inside each class."""
    r = class_ranked(df, label_col, key_col, seed, "fold")
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_n")


def seeded_shuffle(df: DataFrame, key_col: str, seed: int = 42) -> DataFrame:
    """A full shuffle as a range-partitioned sort on the hash."""
    return df.withColumn("shuffle_key", sort_hash(F.col(key_col), seed, "shuffle")).orderBy("shuffle_key", key_col)
