"""Queries for sampling, balancing, folds, shuffles, unions and de-dup."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..operators import dataset as ds
from ..operators import sampling as sm
from ..sources.tables import table
from .registry import register
from .sqlparts import LABELLED_DOCS, round_doubles


def _docs(spark, sf_dir):
    return ds.labelled_documents(spark, sf_dir, with_text=False).select("doc_id", "label")


def _ranked_sql(salt):
    return f"""WITH d AS ({LABELLED_DOCS}),
r AS (SELECT doc_id, label,
        row_number() OVER (PARTITION BY label ORDER BY md5({hz.sql_key('doc_id', "'42'", f"'{salt}'")}), doc_id) AS rn,
        count(*) OVER (PARTITION BY label) AS n FROM d)"""


@register("b1_stratified_split", _ranked_sql("split") + """
SELECT doc_id, label, CASE WHEN rn <= round(CAST(n AS DOUBLE) * 0.3) THEN 'test' ELSE 'train' END AS split FROM r
""")
def b1_stratified_split(spark, sf_dir):
    return sm.stratified_split(_docs(spark, sf_dir)).select("doc_id", "label", "split")


@register("b2_undersample", _ranked_sql("under") + """
SELECT doc_id, label FROM r WHERE rn <= (SELECT min(n) FROM r)
""")
def b2_undersample(spark, sf_dir):
    return sm.undersample(_docs(spark, sf_dir)).select("doc_id", "label")


@register("b3_oversample", _ranked_sql("over") + f""",
c AS (SELECT label, max(n) AS n FROM r GROUP BY label),
dr AS (SELECT label, n, unnest(generate_series(1, (SELECT max(n) FROM c) - n)) AS draw FROM c),
pk AS (SELECT label, draw, CAST(floor({hz.sql_u01('label', 42, 'draw', 'draw')} * n) + 1 AS BIGINT) AS rk FROM dr)
SELECT doc_id, label, CAST(0 AS INTEGER) AS draw FROM r
UNION ALL
SELECT r.doc_id, r.label, CAST(pk.draw AS INTEGER) AS draw FROM pk JOIN r ON r.label = pk.label AND r.rn = pk.rk
""")
def b3_oversample(spark, sf_dir):
    return sm.oversample(_docs(spark, sf_dir)).select("doc_id", "label", "draw")


QUOTAS = {0: 20, 1: 100, 2: 50}


@register("b5_quota_sample", _ranked_sql("quota") + f"""
SELECT doc_id, label FROM r WHERE rn <= CASE label {' '.join(f'WHEN {k} THEN {v}' for k, v in QUOTAS.items())} ELSE 0 END
""")
def b5_quota_sample(spark, sf_dir):
    return sm.quota_sample(_docs(spark, sf_dir), QUOTAS).select("doc_id", "label")


U1_QUOTAS = {0: 10, 1: 10, 2: 10}


@register("u1_union_class_samples", _ranked_sql("quota") + f"""
SELECT doc_id, label FROM r WHERE rn <= CASE label {' '.join(f'WHEN {k} THEN {v}' for k, v in U1_QUOTAS.items())} ELSE 0 END
""")
def u1_union_class_samples(spark, sf_dir):
    return sm.quota_sample(_docs(spark, sf_dir), U1_QUOTAS).select("doc_id", "label")


@register("b6_class_weights", f"""
WITH d AS ({LABELLED_DOCS}), c AS (SELECT label, count(*) AS nc FROM d GROUP BY label)
SELECT d.doc_id, d.label, round(CAST((SELECT sum(nc) FROM c) AS DOUBLE) / (CAST((SELECT count(*) FROM c) AS DOUBLE) * c.nc), 6) AS weight
FROM d JOIN c ON c.label = d.label
""")
def b6_class_weights(spark, sf_dir):
    return round_doubles(sm.class_weights(_docs(spark, sf_dir)).select("doc_id", "label", "weight"))


@register("b7_stratified_folds", _ranked_sql("fold") + """
SELECT doc_id, label, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM r
""")
def b7_stratified_folds(spark, sf_dir):
    return sm.stratified_folds(_docs(spark, sf_dir), k=5).select("doc_id", "label", "fold")


@register("t1_seeded_shuffle", f"""
SELECT doc_id, md5({hz.sql_key('doc_id', "'42'", "'shuffle'")}) AS shuffle_key FROM documents
""")
def t1_seeded_shuffle(spark, sf_dir):
    return sm.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@register("u2_union_by_name", f"""
SELECT doc_id, label FROM ({LABELLED_DOCS})
UNION ALL
SELECT d.doc_id, CAST(NULL AS INTEGER) AS label FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
""")
def u2_union_by_name(spark, sf_dir):
    lab = _docs(spark, sf_dir)
    unl = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return lab.unionByName(unl, allowMissingColumns=True).select("doc_id", "label")


@register("u3_distinct_rows", """
SELECT DISTINCT md5(text) AS text_md5, lang FROM documents
""")
def u3_distinct_rows(spark, sf_dir):
    d = ds.distinct_rows(table(spark, sf_dir, "documents").select("text", "lang"))
    return d.select(F.md5("text").alias("text_md5"), "lang")


@register("w4_dedup_keep_first", """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text
""")
def w4_dedup_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return ds.dedup_keep_first(d, "text", "doc_id", keep=["doc_id", "lang"])


@register("a2_class_proportions", f"""
WITH d AS ({LABELLED_DOCS}), c AS (SELECT label, count(*) AS n FROM d GROUP BY label)
SELECT label, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / (SELECT sum(n) FROM c), 6) AS share FROM c
""")
def a2_class_proportions(spark, sf_dir):
    return round_doubles(ds.class_proportions(_docs(spark, sf_dir)))


@register("a2_split_proportions", _ranked_sql("split") + """,
s AS (SELECT label, CASE WHEN rn <= round(CAST(n AS DOUBLE) * 0.3) THEN 'test' ELSE 'train' END AS split FROM r),
c AS (SELECT split, label, count(*) AS n FROM s GROUP BY split, label)
SELECT split, label, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split), 6) AS share FROM c
""")
def a2_split_proportions(spark, sf_dir):
    from pyspark.sql import Window
    s = sm.stratified_split(_docs(spark, sf_dir))
    c = s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(c.select("split", "label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("split"))).alias("share")))


@register("a3_min_max_class_size", f"""
WITH d AS ({LABELLED_DOCS}), c AS (SELECT label, count(*) AS n FROM d GROUP BY label)
SELECT CAST(min(n) AS BIGINT) AS min_class, CAST(max(n) AS BIGINT) AS max_class FROM c
""")
def a3_min_max_class_size(spark, sf_dir):
    c = _docs(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min("n").cast("bigint").alias("min_class"), F.max("n").cast("bigint").alias("max_class"))
