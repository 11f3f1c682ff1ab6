"""B4 over the linguistic features of the labelled documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions import hashing as hz
from ..operators import dataset as ds
from ..operators import smote as so
from .registry import register
from .sqlfeat import linguistic
from .sqlparts import LABELLED_DOCS, r6, round_doubles

C = fx.LING_COLS


def _sql():
    feats = ", ".join(linguistic("text", "en", False))
    far = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in C)
    u = lambda salt: hz.sql_u01("label", 42, salt, "draw")
    return f"""WITH f AS (SELECT doc_id, label, {feats} FROM ({LABELLED_DOCS}) WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42', 'smote')), doc_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM f),
p AS (SELECT a.label, a.i, b.i AS j, row_number() OVER (PARTITION BY a.label, a.i ORDER BY {far}, b.doc_id) - 1 AS near FROM r a JOIN r b ON a.label = b.label AND a.i <> b.i),
s AS (SELECT label, any_value(n) AS n FROM r GROUP BY label),
d AS (SELECT label, n, unnest(range(1, (SELECT max(n) FROM s) - n + 1)) AS draw FROM s),
x AS (SELECT label, draw, CAST(floor({u('smoteb')} * n) AS BIGINT) AS i, CAST(floor({u('smoten')} * least(5, n - 1)) AS BIGINT) AS near, {u('smoteg')} AS gap FROM d)
SELECT x.label, x.draw, {', '.join(f'{r6(f"a.{c} + x.gap * (b.{c} - a.{c})")} AS {c}' for c in C)}
FROM x JOIN p ON p.label = x.label AND p.i = x.i AND p.near = x.near JOIN r a ON a.label = x.label AND a.i = x.i JOIN r b ON b.label = x.label AND b.i = p.j"""


@register("b4_smote", _sql())
def b4_smote(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir).where("text is not null").select("doc_id", "label", *fx.linguistic(F.col("text"), "en"))
    v = d.select("doc_id", "label", F.array(*(F.col(c).cast("double") for c in C)).alias("vec"))
    made = so.smote(v, "vec")
    return round_doubles(made.select("label", "draw", *(F.col("vec")[i].alias(c) for i, c in enumerate(C))))
