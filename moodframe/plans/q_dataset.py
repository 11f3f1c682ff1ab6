"""Queries for sources-as-tables, validation, preprocessing and class stats."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dataset as ds
from .registry import register
from .sqlparts import LABELLED_DOCS


def _clean_sql(col="text"):
    return tx.sql_clean_text(col, "en")


@register("a1_class_counts", f"""
WITH d AS ({LABELLED_DOCS}),
c AS (SELECT label, {_clean_sql('text')} AS cleaned_text FROM d WHERE text IS NOT NULL),
f AS (SELECT label FROM c WHERE length(cleaned_text) > 3)
SELECT k.label, CAST(count(f.label) AS BIGINT) AS n
FROM (VALUES (0), (1), (2)) k(label) LEFT JOIN f ON f.label = k.label
GROUP BY k.label
""")
def a1_class_counts(spark, sf_dir):
    df = ds.labelled_documents(spark, sf_dir).select("doc_id", "text", "label")
    return ds.class_counts(ds.preprocess(df, "en"))
