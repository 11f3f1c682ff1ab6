"""Mutual information of numeric columns and a class by neighbour distances.

For a value, r is the distance to its k-th nearest other value of the same class
and column and m the number of values of all classes nearer than r (itself
included; where r is 0, those equal to it). With N values of a column, N_c of
class c:  mi = psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), not below 0.

Values are taken to a grid of 10^-decimals, so distances are exact integers. Equal
values of a class are one row with a count from the start (a partial aggregate).
Ranks and the counts up to a value are sums inside (column, value range) plus
offsets of the ranges before it; neighbours come from lag and lead inside blocks of
ranks that also hold the k ranks to either side. No window holds a whole column.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .monitor import join_null_safe

RANGE_ROWS = 1_000_000      # about as many rows in a value range
BLOCK_RANKS = 100_000       # ranks in a block
MOST_RANGES = 4096          # the cuts of a column are broadcast


def digamma(n: Column) -> Column:
    """psi(n) of positive whole numbers: the asymptotic series at n + 10, stepped back."""
    y = n + F.lit(10.0)
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6)
    return series - reduce(Column.__add__, (1 / (n + F.lit(float(i))) for i in range(10)))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the same keys up to each row in
    ``order``; ``_range`` numbers ranges of the first of ``order``."""
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_range").agg(F.sum(weight).alias("_w"))
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))
    summed = join_null_safe(rows.withColumn("_in", F.sum(weight).over(inside)), totals, [*keys, "_range"])
    return summed.withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before")


def kth_distance(own: Column, near: list[tuple[Column, Column]], k: Column) -> Column:
    """Smallest distance within which lie k others: ``own`` equal ones and the
    (distance, count) of values to either side, null past an end."""
    reach = [F.when(own + reduce(Column.__add__, (F.when(e <= d, n).otherwise(0) for e, n in near)) >= k, d) for d, _ in near]
    return F.when(own >= k, F.lit(0).cast("long")).otherwise(F.least(*reach) if len(reach) > 1 else reach[0])


def neighbour_information(df: DataFrame, columns: list[str], label: str = "label", k: int = 3, decimals: int = 6) -> DataFrame:
    """(feature, mi) in nats, a row per column that has values. Rows without label
    take no part, nor do null, NaN and infinite values in their column, or classes
    with one value in it. A column without two values of one class gives no row."""
    if k < 1:
        raise ValueError("k must be at least 1")
    x = F.col("_v.x")
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("c"), F.explode(F.array(*(
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("_v"))
    long = long.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    values = long.select(F.col("_v.feature").alias("feature"), "c", F.round(x * 10.0 ** decimals).cast("long").alias("x"))
    values = materialize(values.groupBy("feature", "c", "x").agg(F.count(F.lit(1)).alias("n")), "mi-values")

    classes = values.groupBy("feature", "c").agg(F.sum("n").alias("n_c")).where(F.col("n_c") > 1)
    most = values.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    ranges = min(MOST_RANGES, -(-most // RANGE_ROWS))
    cuts = F.array().cast("array<bigint>")
    if ranges > 1:
        cuts = F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10 * MOST_RANGES)
    cuts = F.broadcast(values.groupBy("feature").agg((cuts if ranges > 1 else F.any_value(cuts)).alias("_cuts")))       # a row per column

    def ranged(rows):
        return rows.join(cuts, "feature").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("x")))).drop("_cuts")
    values = ranged(values.join(F.broadcast(classes), ["feature", "c"])).withColumn("k", F.least(F.lit(k), F.col("n_c") - 1))      # a row per column and class

    # the k values to either side, from blocks of ranks with k more at both ends
    ranked = running_sum(values.withColumn("_one", F.lit(1)), ["feature", "c"], ["x"], "_one", "_rank").drop("_one")
    size = max(BLOCK_RANKS, k)
    first, last = F.floor((F.col("_rank") - k) / size), F.floor((F.col("_rank") + k) / size)
    dealt = ranked.withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("feature", "c", "_block").orderBy("x")
    sides = [f(F.struct("x", "n"), i).over(w) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    near = dealt.select("*", *(s.alias(f"_s{i}") for i, s in enumerate(sides))).where(F.floor(F.col("_rank") / size) == F.col("_block"))
    r = kth_distance(F.col("n") - 1, [(F.abs(F.col(f"_s{i}.x") - F.col("x")), F.col(f"_s{i}.n")) for i in range(2 * k)], F.col("k"))
    reach = F.greatest(r, F.lit(1))
    asked = materialize(near.select("feature", "c", "x", "n", "n_c", "k", reach.alias("r")), "mi-reach")

    # values nearer than r: those up to x + r - 1 less those up to x - r
    ends = asked.select("feature", F.explode(F.array(F.struct((F.col("x") + F.col("r") - 1).alias("x"), F.lit(1).alias("sign")),
                                                     F.struct((F.col("x") - F.col("r")).alias("x"), F.lit(-1).alias("sign")))).alias("e"),
                        F.struct("c", F.col("x").alias("at")).alias("whose"))
    ends = ranged(ends.select("feature", F.col("e.x").alias("x"), F.lit(0).cast("long").alias("n"), F.col("e.sign").alias("sign"), "whose"))
    data = values.select("feature", "x", "n", F.lit(0).alias("sign"), F.lit(None).cast(ends.schema["whose"].dataType).alias("whose"), "_range")
    counted = running_sum(data.unionByName(ends).withColumn("_asks", F.col("sign") != 0), ["feature"], ["x", "_asks"], "n", "_upto")
    m = counted.where("sign <> 0").groupBy("feature", "whose").agg(F.sum(F.col("sign") * F.col("_upto")).alias("m"))
    m = m.select("feature", F.col("whose.c").alias("c"), F.col("whose.at").alias("x"), "m")

    term = digamma(F.col("k")) - digamma(F.col("n_c")) - digamma(F.col("m"))
    told = asked.join(m, ["feature", "c", "x"]).groupBy("feature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * term).alias("s"))
    return told.select("feature", F.greatest(digamma(F.col("n")) + F.col("s") / F.col("n"), F.lit(0.0)).alias("mi"))
