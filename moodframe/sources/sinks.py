"""Sinks (K1-K3, K7, K8). Writers overwrite or append whole folders; the
ingest sink partitions by source and ingest time."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1 processed / predicted dataset."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_ingest(df: DataFrame, path: str, source: str, ingest_ts: str) -> bool:
    """K2: append under source=/ingest_ts=; skipped when empty."""
    if df.isEmpty():
        return False
    (df.withColumn("source", F.lit(source)).withColumn("ingest_ts", F.lit(ingest_ts))
       .write.mode("append").partitionBy("source", "ingest_ts").parquet(path))
    return True


def write_ingests(df: DataFrame, path: str, ingest_ts: str, source: str = "source") -> None:
    """K2 for many sources in one job: rows land under their own source=."""
    (df.withColumnRenamed(source, "source").withColumn("ingest_ts", F.lit(ingest_ts))
       .write.mode("append").partitionBy("source", "ingest_ts").parquet(path))


def append_labelled(df: DataFrame, path: str) -> None:
    """K3: append to an existing labelled set."""
    df.write.mode("append").parquet(path)


def metric_rows(df: DataFrame) -> DataFrame:
    """K7: numeric columns of a one-row metrics table -> (metric, value)
    rows with the value formatted to 4 decimals."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer")]
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                             for c in num])).alias("m")).select("m.*")
    return stacked.select("metric", F.format_number("value", 4).alias("value"))


def write_lines(df: DataFrame, col: str, path: str) -> None:
    """K8 export of (filtered) log lines as text."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
