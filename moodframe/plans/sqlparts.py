"""Shared DuckDB SQL fragments for the oracle queries."""
from __future__ import annotations

LABEL_CASE = "CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END"

LABELLED_DOCS = f"""SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
       CAST({LABEL_CASE} AS INTEGER) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def round_doubles(df, digits: int = 6):
    """Round every DOUBLE/FLOAT column (top level) for the oracle compare."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
