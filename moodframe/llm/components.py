"""Connected components of an edge table, in Spark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the
    smallest node of its component.

    Alternates large-star and small-star: every node links its larger
    neighbours (then itself and its smaller ones) to the smallest node it sees,
    until each component is a star. The number of rounds grows with the
    logarithm of the longest path. Minima are partial aggregates and the joins
    back are plain equi-joins, so a node with very many neighbours is split by
    the skew join; each round is a written table, nothing is collected.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    last = _state(links)
    while True:
        # minima are written tables: a join of two plain exchanges can be split
        # where a node has very many links, one above an aggregate can't
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct(), name)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        now = _state(links)
        if now == last:
            break
        last = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(links: DataFrame) -> tuple:
    """Row count and a digest that doesn't depend on the order of rows."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(h.bitwiseAND((1 << 40) - 1)), F.bit_xor(h)).first())
