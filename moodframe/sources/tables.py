"""Reading the input tables.

Tables are plain Parquet; reading through ``spark.read.parquet`` keeps
column pruning and filter pushdown into the scan.

Text tables feed CPU-heavy per-row work (regexes over whole documents). A
Parquet file is split by row group, so a file written as one row group
scans as one partition; when a text table arrives in fewer partitions than
the cluster has cores, its rows are spread round-robin first. On large
inputs the scan already yields far more partitions than cores and nothing is
added.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import small_batches

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

TEXT_TABLES = {"documents", "pages", "conversations"}
SPREAD_FACTOR = 3


def table(spark: SparkSession, sf_dir: str, name: str, spread_text: bool = True) -> DataFrame:
    """``spread_text=False`` for jobs that never read the text columns."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name in TEXT_TABLES and spread_text:
        small_batches(spark)
        df = spread(df)
    return df


def spread(df: DataFrame, factor: int = SPREAD_FACTOR) -> DataFrame:
    """Round-robin the rows over ``factor`` x cores partitions when the input
    has fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * factor)
    return df
