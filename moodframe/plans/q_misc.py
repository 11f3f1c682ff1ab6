"""Queries for retention sets, map/array normalisation and lookups."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import augment as ag
from ..operators import emotion as em
from ..operators import evaluate as ev
from ..operators import monitor as mo
from ..sources.tables import table
from . import sqlfeat as sf
from .q_features import DECORATED_SQL as DEC_SQL, LABEL_CASE_L, _decorated_docs
from .q_monitor import CKPT_SQL, _ckpts
from .registry import register
from .sqlparts import r6, round_doubles


@register("k5_checkpoint_retention_delete_set", f"""WITH c AS ({CKPT_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ts DESC, event_id DESC) AS rank FROM c)
SELECT language, CAST(count(*) AS BIGINT) AS to_delete FROM r WHERE rank > {lx.MAX_CHECKPOINTS} GROUP BY language""")
def k5_checkpoint_retention_delete_set(spark, sf_dir):
    """K5: checkpoints outside the newest five per language (the folders a
    retention job removes): all minus the kept top-5 (anti join)."""
    c = _ckpts(spark, sf_dir)
    keep = mo.top_k_per_group(c, "language", [F.col("ts").desc(), F.col("event_id").desc()], lx.MAX_CHECKPOINTS,
                              bucket_key="event_id").select("event_id")
    return c.join(keep, "event_id", "left_anti").groupBy("language").agg(F.count(F.lit(1)).alias("to_delete"))


def _decision(c):
    return (hz.u01(F.col("doc_id"), 42, "dec", c) - 0.5) * 4.0


def _decision_sql(c):
    return f"(({hz.sql_u01('doc_id', 42, 'dec', str(c))} - 0.5) * 4.0::DOUBLE)"


@register("y3_y4_sigmoid_normalise", f"""WITH d AS (SELECT doc_id, {', '.join(f'1.0 / (1.0 + exp(-{_decision_sql(c)})) AS s{c}' for c in range(3))} FROM labels)
SELECT doc_id, {', '.join(f"{r6(f's{c} / (s0 + s1 + s2)')} AS p{c}" for c in range(3))} FROM d""")
def y3_y4_sigmoid_normalise(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id", F.array(*[_decision(c) for c in range(3)]).alias("dec"))
    p = d.select("doc_id", ev.sigmoid_normalise(F.col("dec")).alias("p"))
    return round_doubles(p.select("doc_id", *[F.col("p")[c].alias(f"p{c}") for c in range(3)]))


def _y58_sql():
    raw, denom = sf.emotion_score_parts("text")
    sent = {e: s for e, _, s, _, _ in lx.EMOTION_MAPPING}
    cols = ", ".join(f"{s} / {denom} AS s_{e}" for e, s in raw)
    valid = lambda lab: [e for e, _ in raw if sent[e] == lab]
    parts = []
    for lab in (0, 1, 2):
        ssum = " + ".join(f"s_{e}" for e in valid(lab))
        parts.append((lab, ssum, valid(lab)))
    tot = "CASE " + " ".join(f"WHEN label = {lab} THEN ({ssum})" for lab, ssum, _ in parts) + " END"
    mx = "CASE " + " ".join(f"WHEN label = {lab} THEN greatest({', '.join(f's_{e}' for e in v)})" for lab, _, v in parts) + " END"
    n = "CASE " + " ".join(f"WHEN label = {lab} THEN {len(v)}" for lab, _, v in parts) + " END"
    return f"""WITH d AS (SELECT dd.doc_id, dd.text, l.label FROM ({DEC_SQL}) dd JOIN (SELECT doc_id, {LABEL_CASE_L} AS label FROM labels) l ON l.doc_id = dd.doc_id),
s AS (SELECT doc_id, label, {cols} FROM d),
t AS (SELECT doc_id, {n} AS n_valid, {tot} AS tot, {mx} AS mx FROM s)
SELECT doc_id, CAST(n_valid AS INTEGER) AS n_valid, {r6('mx / CASE WHEN tot = 0 THEN 1.0 ELSE tot END')} AS top_share FROM t"""


@register("y5_y8_filter_and_normalise_map", _y58_sql())
def y5_y8_filter_and_normalise_map(spark, sf_dir):
    """Keep the emotion-score entries of the document's sentiment
    (map_filter against the emotion dimension); Y5: renormalise the kept
    values to sum 1 (sum 0 -> divide by 1)."""
    d = _decorated_docs(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("label"))
    s = d.join(lab, "doc_id").withColumn("scores", em.emotion_scores(F.col("text")))
    sent_map = F.create_map(*[x for e, _, st, _, _ in lx.EMOTION_MAPPING for x in (F.lit(e), F.lit(st))])
    kept = F.map_filter("scores", lambda k, v: F.element_at(sent_map, k) == F.col("label"))
    # a value read inside a lambda is bound first, else it is worked out per entry
    norm = s.withColumn("norm", hz.let(kept, lambda m: F.map_from_arrays(F.map_keys(m), em.normalised(F.map_values(m)))))
    return round_doubles(norm.select("doc_id", F.size("norm").alias("n_valid"), F.array_max(F.map_values("norm")).alias("top_share")))


@register("j6_g9_variant_lookup", f"""WITH d AS (SELECT doc_id, {tx.sql_split_ws('text')} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: coalesce(CASE lower(x) {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in ag.VARIANTS.items())} END, x)), ' ')) AS aug_md5 FROM d""")
def j6_g9_variant_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", tx.split_ws(F.col("text")).alias("w"))
    return d.select("doc_id", F.md5(F.array_join(ag.variant_lookup(F.col("w")), " ")).alias("aug_md5"))


@register("g14_keep_deletion", f"""WITH d AS (SELECT doc_id, {tx.sql_split_ws('text')} AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, list_filter(w, lambda x, i: {hz.sql_u01('doc_id', 42, 'g14', 'i - 1')} < 0.9) AS kept FROM d)
SELECT doc_id, md5(array_to_string(CASE WHEN len(kept) = 0 THEN w ELSE kept END, ' ')) AS aug_md5 FROM k""")
def g14_keep_deletion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", tx.split_ws(F.col("text")).alias("w"))
    return d.select("doc_id", F.md5(F.array_join(ag.keep_deletion(F.col("w"), F.col("doc_id")), " ")).alias("aug_md5"))


def _g8_sql():
    u = lambda salt: hz.sql_u01("doc_id", 42, salt, "i - 1")
    pos = f"(CAST(floor({u('g8p')} * (length(x) - 1)) AS INTEGER) + 1)"
    cur = f"lower(substring(x, {pos} + 1, 1))"
    cands = "CASE " + cur + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ag.KEY_NEIGHBOURS.items()) + " END"
    ch = f"substring({cands}, CAST(floor({u('g8c')} * length({cands})) AS INTEGER) + 1, 1)"
    new = f"substring(x, 1, {pos}) || {ch} || substring(x, {pos} + 2)"
    return f"""WITH d AS (SELECT doc_id, {tx.sql_split_ws('text')} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda x, i: CASE WHEN length(x) >= 4 AND {u('g8')} <= 0.3 AND ({cands}) IS NOT NULL
  THEN {new} ELSE x END), ' ')) AS aug_md5 FROM d"""


@register("g8_keyboard_typos", _g8_sql())
def g8_keyboard_typos(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", tx.split_ws(F.col("text")).alias("w"))
    return d.select("doc_id", F.md5(F.array_join(ag.apply_typos(F.col("w"), F.col("doc_id")), " ")).alias("aug_md5"))


Y10_TEMPLATE = "Doc {id} in {lang}: the {item} was {adverb} {unknown}."


@register("y10_placeholder_fill", f"""SELECT doc_id,
  regexp_replace(replace(replace(replace(replace('{Y10_TEMPLATE}', '{{id}}', CAST(doc_id AS VARCHAR)), '{{lang}}', lang),
    '{{item}}', {lx.sql_str_list(ag.FILLERS['item'])}[{hz.sql_pick_index(str(len(ag.FILLERS['item'])), 'doc_id', 42, 'y10i')} + 1]),
    '{{adverb}}', {lx.sql_str_list(ag.FILLERS['adverb'])}[{hz.sql_pick_index(str(len(ag.FILLERS['adverb'])), 'doc_id', 42, 'y10a')} + 1]),
    '\\{{[A-Za-z0-9_]+\\}}', '', 'g') AS filled FROM documents""")
def y10_placeholder_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents", spread_text=False).select("doc_id", "lang")
    item = F.element_at(F.array(*[F.lit(x) for x in ag.FILLERS["item"]]), hz.pick_index(len(ag.FILLERS["item"]), F.col("doc_id"), 42, "y10i") + 1)
    adv = F.element_at(F.array(*[F.lit(x) for x in ag.FILLERS["adverb"]]), hz.pick_index(len(ag.FILLERS["adverb"]), F.col("doc_id"), 42, "y10a") + 1)
    fillers = F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"),
                           F.lit("item"), item, F.lit("adverb"), adv)
    return d.select("doc_id", ag.fill_placeholders(F.lit(Y10_TEMPLATE), fillers).alias("filled"))
