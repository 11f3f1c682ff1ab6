"""Synthetic minority rows on feature vectors (SMOTE).

Neighbours are exact within a class, over all of its labelled rows (see
``pivots``). No class passes through the driver or one task.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hz
from .pivots import nearest, neighbours_in_class
from .sampling import class_ranked


def neighbours(matrix: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each of ``rows``, nearest first, ties by id."""
    return nearest(matrix[rows], rows, matrix, np.arange(len(matrix)), ids, k)[1].reshape(len(rows), k)


def smote(df: DataFrame, vec: str, label: str = "label", key: str = "doc_id", k: int = 5, seed: int = 42) -> DataFrame:
    """(label, draw, vec): for every class as many synthetic rows as it lacks to
    the largest. Draw i takes a row of the class, one of its ``k`` nearest
    neighbours and a point between them, all by ``u01(label, i)``. A class of one
    row gives none, rows without label or vector are left out. A vector with a null
    or non-finite number counts as a row of its class, but nothing is drawn from
    it."""
    spark = df.sparkSession
    rows = df.select(key, label, vec).where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    lacks = {c: max(sizes.values()) - n for c, n in sorted(sizes.items()) if n < max(sizes.values())}
    # the vectors of these classes are made once; all that follows reads them several times
    small = rows.where(F.col(label).isin(list(lacks))).checkpoint()
    small = small.where(F.forall(F.col(vec).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = {r[0]: r[1] for r in small.groupBy(label).agg(F.count(F.lit(1))).collect()}
    lacks = {c: n for c, n in lacks.items() if sizes.get(c, 0) > 1}
    schema = rows.select(label, F.lit(0).cast("long").alias("draw"), vec).schema
    if not lacks:
        return spark.createDataFrame([], schema)
    ranked = class_ranked(small.where(F.col(label).isin(list(lacks))), label, key, seed, "smote")
    ranked = ranked.select(F.col(label).alias("c"), (F.col("_rank") - 1).cast("long").alias("at"), F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).checkpoint()

    def drawn(c, need):
        u = lambda salt: hz.u01(F.lit(c), seed, salt, F.col("draw"))
        return spark.range(1, need + 1).select(F.col("id").alias("draw")).select(
            F.lit(c).cast(schema[label].dataType).alias("c"), "draw", F.floor(u("smoteb") * sizes[c]).alias("base"),
            F.floor(u("smoten") * min(k, sizes[c] - 1)).cast("int").alias("near"), u("smoteg").alias("gap"))
    draws = reduce(DataFrame.unionByName, (drawn(c, need) for c, need in lacks.items()))

    best = neighbours_in_class(ranked, draws.select("c", "base").distinct(), k)
    pairs = draws.join(best, ["c", "base"]).select("c", "draw", "gap", "base", F.get("best", F.col("near")).alias("other"))
    pairs = pairs.join(ranked.select("c", F.col("at").alias("base"), F.col("v").alias("a")), ["c", "base"])
    pairs = pairs.join(ranked.select("c", F.col("at").alias("other"), F.col("v").alias("b")), ["c", "other"])
    gap = F.col("gap")
    return pairs.select(F.col("c").alias(label), "draw", F.zip_with("a", "b", lambda a, b: a + gap * (b - a)).cast(schema[vec].dataType).alias(vec))
