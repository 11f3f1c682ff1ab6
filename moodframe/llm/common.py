"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED: a word is a maximal run of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z
# became a-z: over UTF-8 that is digits, letters a-z and bytes from 0x80.
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))


def word_table() -> bytes:
    """256-byte translation: word bytes keep (A-Z lower-cased), others -> 0x20."""
    out = bytearray(b" " * 256)
    for b in _WORD_BYTES:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


WORD_TABLE = word_table()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor
    sees. The setting is read from the session; one of our own is set only
    where there is none and the master is local (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and
    readable by every executor after others were lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row. A plain column
    used inside a lambda may be inlined there and evaluated per element; a
    lambda variable can't be."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)  # body may have further, optional parameters


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def by_bytes(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of about ``limit`` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def flips(bits: int, most: int) -> np.ndarray:
    """All 64-bit masks with up to ``most`` of the lowest ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)], dtype=np.uint64)
