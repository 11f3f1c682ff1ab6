"""Queries for voting, evaluation, reports, AUC, model comparison and folds.

Three "model" predictions per labelled document are deterministic picks:
right with probability 0.7, otherwise a hashed class; probabilities are
hashed weights with a bonus on the predicted class. Every confusion cell is
therefore populated and the metrics are non-trivial.
"""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import hashing as hz
from ..functions import lexicon as lx
from ..operators import dataset as ds
from ..operators import evaluate as ev
from ..operators import sampling as sm
from ..sources.tables import table
from .registry import register
from .sqlparts import LABELLED_DOCS, r6, round_doubles

K = 3
THIRD = 1.0 / 3


def _pred(k):
    return F.when(hz.u01(F.col("doc_id"), 42, f"m{k}") < 0.7, F.col("label")).otherwise(
        hz.pick_index(3, F.col("doc_id"), 42, f"alt{k}"))


def _probs(k):
    raw = [hz.u01(F.col("doc_id"), 42, f"p{k}", c) + F.when(F.col(f"p{k}") == c, F.lit(1.0)).otherwise(F.lit(0.0))
           for c in range(3)]
    tot = raw[0] + raw[1] + raw[2]
    return F.array(*[r / tot for r in raw])


def scored(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir, with_text=False).select("doc_id", "label", "lang")
    for k in range(1, K + 1):
        d = d.withColumn(f"p{k}", _pred(k))
    d = d.select("*", *[_probs(k).alias(f"probs{k}") for k in range(1, K + 1)])
    d = d.withColumn("prediction", ev.hard_vote([F.col(f"p{k}") for k in range(1, K + 1)]))
    d = d.withColumn("probs", ev.soft_vote([F.col(f"probs{k}") for k in range(1, K + 1)]))
    d = d.withColumn("wprobs", ev.soft_vote([F.col(f"probs{k}") for k in range(1, K + 1)], lx.ENSEMBLE_WEIGHTS))
    return d


def _sql_dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _scored_sql():
    preds = ", ".join(
        f"CASE WHEN {hz.sql_u01('doc_id', 42, f'm{k}')} < 0.7 THEN label ELSE {hz.sql_pick_index('3', 'doc_id', 42, f'alt{k}')} END AS p{k}"
        for k in range(1, K + 1))
    raws = []
    for k in range(1, K + 1):
        for c in range(3):
            raws.append(f"({hz.sql_u01('doc_id', 42, f'p{k}', str(c))} + CASE WHEN p{k} = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r{k}{c}")
    probs = ", ".join(f"r{k}{c} / (r{k}0 + r{k}1 + r{k}2) AS q{k}{c}" for k in range(1, K + 1) for c in range(3))
    mean = ", ".join(" + ".join(f"q{k}{c} * {_sql_dbl(THIRD)}" for k in range(1, K + 1)) + f" AS pr{c}" for c in range(3))
    wmean = ", ".join(" + ".join(f"q{k}{c} * {_sql_dbl(w)}" for k, w in zip(range(1, K + 1), lx.ENSEMBLE_WEIGHTS)) + f" AS wp{c}"
                      for c in range(3))
    cnt = {c: " + ".join(f"CAST(p{k} = {c} AS INTEGER)" for k in range(1, K + 1)) for c in range(3)}
    vote = (f"CASE WHEN ({cnt[0]}) >= ({cnt[1]}) AND ({cnt[0]}) >= ({cnt[2]}) THEN 0 "
            f"WHEN ({cnt[1]}) >= ({cnt[2]}) THEN 1 ELSE 2 END")
    return f"""d AS ({LABELLED_DOCS}),
p0 AS (SELECT doc_id, label, lang, {preds} FROM d),
p1 AS (SELECT *, {', '.join(raws)} FROM p0),
p2 AS (SELECT *, {probs} FROM p1),
s AS (SELECT *, {mean}, {wmean}, CAST({vote} AS INTEGER) AS prediction FROM p2)"""


SCORED = _scored_sql()


def _report_sql(src: str, by: str | None = None) -> str:
    """CTEs cc, cls, pc, f over ``src(label, prediction[, by])``."""
    g = f"{by}, " if by else ""
    on = f" AND cc.{by} = cls.{by}" if by else ""
    return f"""cc AS (SELECT {g}label, prediction, count(*) AS n FROM {src} GROUP BY ALL),
cls AS (SELECT {g}label AS cls FROM cc UNION SELECT {g}prediction AS cls FROM cc),
pc AS (SELECT cls.*,
   coalesce((SELECT sum(n) FROM cc WHERE cc.label = cls.cls AND cc.prediction = cls.cls{on}), 0) AS tp,
   coalesce((SELECT sum(n) FROM cc WHERE cc.label = cls.cls{on}), 0) AS support,
   coalesce((SELECT sum(n) FROM cc WHERE cc.prediction = cls.cls{on}), 0) AS pred_n FROM cls),
m AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0::DOUBLE END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0::DOUBLE END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM m)"""


# ---- voting -----------------------------------------------------------------------

@register("m14_hard_vote", f"WITH {SCORED} SELECT doc_id, p1, p2, p3, prediction FROM s")
def m14_hard_vote(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "p1", "p2", "p3", "prediction")


@register("m15_soft_vote", f"WITH {SCORED} SELECT doc_id, {', '.join(f'{r6(f'pr{c}')} AS prob_{c}' for c in range(3))} FROM s")
def m15_soft_vote(spark, sf_dir):
    s = scored(spark, sf_dir)
    return round_doubles(s.select("doc_id", *[F.col("probs")[c].alias(f"prob_{c}") for c in range(3)]))


@register("m16_weighted_soft_vote", f"WITH {SCORED} SELECT doc_id, {', '.join(f'{r6(f'wp{c}')} AS wprob_{c}' for c in range(3))} FROM s")
def m16_weighted_soft_vote(spark, sf_dir):
    s = scored(spark, sf_dir)
    return round_doubles(s.select("doc_id", *[F.col("wprobs")[c].alias(f"wprob_{c}") for c in range(3)]))


@register("m17_confidence", f"""WITH {SCORED}
SELECT doc_id, {r6('greatest(pr0, pr1, pr2)')} AS confidence, {r6('greatest(pr0, pr1, pr2) * 0.8::DOUBLE')} AS emotion_confidence FROM s""")
def m17_confidence(spark, sf_dir):
    from ..operators.emotion import confidences
    s = scored(spark, sf_dir)
    c, e = confidences(F.col("probs"))
    return round_doubles(s.select("doc_id", c.alias("confidence"), e.alias("emotion_confidence")))


# ---- A4 - A9 ------------------------------------------------------------------------

@register("a4_confusion_matrix", f"""WITH {SCORED}
SELECT label, {', '.join(f'CAST(count(*) FILTER (WHERE prediction = {c}) AS BIGINT) AS pred_{c}' for c in range(3))}
FROM s GROUP BY label""")
def a4_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(scored(spark, sf_dir))


@register("a5_classification_report", f"""WITH {SCORED}, {_report_sql('s')}
SELECT CAST(cls AS VARCHAR) AS class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {r6('sum(precision * support) / sum(support)')}, {r6('sum(recall * support) / sum(support)')},
  {r6('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM f""")
def a5_classification_report(spark, sf_dir):
    return round_doubles(ev.classification_report(scored(spark, sf_dir)))


@register("a6_scores_by_language", f"""WITH {SCORED}, {_report_sql('s', 'lang')}
SELECT lang, {r6('sum(tp) / sum(support)')} AS accuracy, {r6('sum(precision * support) / sum(support)')} AS precision,
  {r6('sum(recall * support) / sum(support)')} AS recall, {r6('sum(f1 * support) / sum(support)')} AS f1 FROM f GROUP BY lang""")
def a6_scores_by_language(spark, sf_dir):
    return round_doubles(ev.grouped_scores(scored(spark, sf_dir), ["lang"]))


@register("a7_balanced_accuracy", f"""WITH {SCORED}, {_report_sql('s')}
SELECT {r6('avg(recall)')} AS balanced_accuracy FROM f WHERE support > 0""")
def a7_balanced_accuracy(spark, sf_dir):
    return round_doubles(ev.balanced_accuracy(scored(spark, sf_dir)))


_AUC_BASE = f"""WITH {SCORED},
sc AS (SELECT label, unnest([0, 1, 2]) AS cls, unnest([pr0, pr1, pr2]) AS score FROM s),
g AS (SELECT cls, score, sum(CASE WHEN label = cls THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label <> cls THEN 1 ELSE 0 END) AS neg
      FROM sc GROUP BY cls, score),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
                coalesce(sum(pos) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below FROM g)"""


@register("a8_ovr_auc", _AUC_BASE + f"""
SELECT cls, {r6('sum(pos * (neg_below + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg))')} AS auc FROM c GROUP BY cls""")
def a8_ovr_auc(spark, sf_dir):
    return round_doubles(ev.ovr_auc(scored(spark, sf_dir)))


@register("a8_roc_points", _AUC_BASE + f""",
t AS (SELECT cls, sum(pos) AS P, sum(neg) AS N FROM g GROUP BY cls)
SELECT c.cls, {r6('c.score')} AS threshold, {r6('(t.P - c.pos_below) / t.P')} AS tpr, {r6('(t.N - c.neg_below) / t.N')} AS fpr
FROM c JOIN t ON c.cls = t.cls""")
def a8_roc_points(spark, sf_dir):
    return round_doubles(ev.roc_points(scored(spark, sf_dir)))


@register("a9_composite_score", f"""WITH {SCORED}, {_report_sql('s')},
z AS (SELECT cls, CASE WHEN pred_n > 0 THEN precision ELSE 1.0::DOUBLE END AS p, recall AS r FROM f),
y AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM z)
SELECT cls AS label, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f')} AS f1,
  {r6("0.4::DOUBLE * p + 0.4::DOUBLE * r + 0.2::DOUBLE * f")} AS composite FROM y""")
def a9_composite_score(spark, sf_dir):
    return round_doubles(ev.composite_scores(scored(spark, sf_dir)))


@register("a13_text_length_histogram", """
SELECT CAST(floor(length(text) / 500.0) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def a13_text_length_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return ev.histogram(d, F.length("text"), 500.0)


@register("a14_error_analysis", f"""WITH {SCORED}
SELECT label, prediction, CAST(count(*) AS BIGINT) AS n FROM s WHERE label <> prediction GROUP BY label, prediction""")
def a14_error_analysis(spark, sf_dir):
    return ev.error_analysis(scored(spark, sf_dir))


@register("a15_score_distribution", f"""WITH {SCORED}
SELECT CAST(floor(greatest(pr0, pr1, pr2) / 0.1::DOUBLE) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""")
def a15_score_distribution(spark, sf_dir):
    s = scored(spark, sf_dir)
    return ev.histogram(s, F.array_max("probs"), 0.1)


@register("a21_labelled_accuracy", f"""WITH {SCORED}
SELECT {r6('avg(CAST(label = prediction AS DOUBLE))')} AS accuracy, CAST(count(*) AS BIGINT) AS n FROM s""")
def a21_labelled_accuracy(spark, sf_dir):
    return round_doubles(ev.accuracy(scored(spark, sf_dir)))


@register("m22_evaluate_scored", f"""WITH {SCORED}, {_report_sql('s')}
SELECT {r6('sum(tp) / sum(support)')} AS accuracy, {r6('avg(f1)')} AS macro_f1,
       {r6('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM f""")
def m22_evaluate_scored(spark, sf_dir):
    rep = ev.classification_report(scored(spark, sf_dir))
    wide = rep.groupBy().agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("weighted_f1"))
    return round_doubles(wide)


# ---- model comparison (A16, A17) ---------------------------------------------------------

def _per_model(spark, sf_dir):
    s = scored(spark, sf_dir)
    long = s.select("label", F.explode(F.array(*[F.struct(F.lit(f"m{k}").alias("model"), F.col(f"p{k}").alias("prediction"))
                                                 for k in range(1, K + 1)])).alias("m"))
    long = long.select("label", "m.model", "m.prediction")
    return ev.grouped_scores(long, ["model"])


def _per_model_sql():
    union = " UNION ALL ".join(f"SELECT 'm{k}' AS model, label, p{k} AS prediction FROM s" for k in range(1, K + 1))
    return f"""WITH {SCORED}, lm AS ({union}), {_report_sql('lm', 'model')},
pm AS (SELECT model, sum(tp) / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1 FROM f GROUP BY model),
mt AS (SELECT model, CASE WHEN model = 'm2' THEN f1 END AS best_score, CASE WHEN model = 'm3' THEN accuracy END AS test_score,
         CASE WHEN model <> 'm2' THEN f1 END AS f1_score, accuracy FROM pm),
sc AS (SELECT model, CAST(substr(model, 2) AS INTEGER) AS idx, coalesce(best_score, test_score, f1_score, accuracy) AS score FROM mt)"""


def _model_scores(spark, sf_dir):
    pm = _per_model(spark, sf_dir)
    mt = pm.select("model",
                   F.when(F.col("model") == "m2", F.col("f1")).alias("best_score"),
                   F.when(F.col("model") == "m3", F.col("accuracy")).alias("test_score"),
                   F.when(F.col("model") != "m2", F.col("f1")).alias("f1_score"), "accuracy")
    return mt.select("model", F.substring("model", 2, 10).cast("int").alias("idx"),
                     F.coalesce("best_score", "test_score", "f1_score", "accuracy").alias("score"))


@register("a16_model_comparison", _per_model_sql() + f"""
SELECT model, {r6('score')} AS score FROM sc""")
def a16_model_comparison(spark, sf_dir):
    return round_doubles(_model_scores(spark, sf_dir).select("model", "score"))


@register("a17_best_model", _per_model_sql() + f"""
SELECT arg_max(model, (round(score, 12), -idx)) AS best_model FROM sc""")
def a17_best_model(spark, sf_dir):
    sc = _model_scores(spark, sf_dir)
    return sc.agg(F.max_by("model", F.struct(F.round("score", 12), -F.col("idx"))).alias("best_model"))


# ---- folds: A18, W8, W12 -----------------------------------------------------------------

FOLDS = 10


def _fold_scores(spark, sf_dir):
    """(model, fold, train_f1, valid_f1): confusion counts per fold, train
    counts as totals minus the fold (counts are additive), all on the small
    aggregated table."""
    s = scored(spark, sf_dir)
    f = sm.stratified_folds(s, k=FOLDS, seed=42)
    long = f.select("fold", "label", F.explode(F.array(*[F.struct(F.lit(f"m{k}").alias("model"), F.col(f"p{k}").alias("prediction"))
                                                         for k in range(1, K + 1)])).alias("m"))
    cc = long.groupBy("m.model", "fold", "label", "m.prediction").agg(F.count(F.lit(1)).alias("n"))
    folds = F.sequence(F.lit(0), F.lit(FOLDS - 1))
    train_cc = (cc.select("model", "label", "prediction", "n", F.explode(F.filter(folds, lambda x: x != F.col("fold"))).alias("fold"))
                  .groupBy("model", "fold", "label", "prediction").agg(F.sum("n").alias("n")))

    def wf1(c):
        pc = ev.per_class(c, ["model", "fold"])
        return pc.groupBy("model", "fold").agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))
    return (wf1(train_cc).withColumnRenamed("f1", "train_f1")
            .join(wf1(cc).withColumnRenamed("f1", "valid_f1"), ["model", "fold"]))


def _fold_sql(seed=42):
    union = " UNION ALL ".join(f"SELECT 'm{k}' AS model, fold, label, p{k} AS prediction FROM fs" for k in range(1, K + 1))
    return f"""WITH {SCORED},
r AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5({hz.sql_key('doc_id', f"'{seed}'", "'fold'")}), doc_id) AS rn FROM s),
fs AS (SELECT *, CAST((rn - 1) % {FOLDS} AS INTEGER) AS fold FROM r),
lm AS ({union}),
vcc AS (SELECT model, fold, label, prediction, count(*) AS n FROM lm GROUP BY ALL),
tcc AS (SELECT v.model, t.fold, v.label, v.prediction, sum(v.n) AS n FROM vcc v
        JOIN (SELECT DISTINCT fold FROM fs) t ON t.fold <> v.fold GROUP BY ALL),
""" + ",\n".join(_wf1_sql(src, name) for src, name in (("vcc", "vf"), ("tcc", "tf"))) + """,
fsc AS (SELECT vf.model, vf.fold, tf.f1 AS train_f1, vf.f1 AS valid_f1 FROM vf JOIN tf ON vf.model = tf.model AND vf.fold = tf.fold)"""


def _wf1_sql(src, name):
    return f"""{name}_cls AS (SELECT model, fold, label AS cls FROM {src} UNION SELECT model, fold, prediction FROM {src}),
{name}_pc AS (SELECT c.model, c.fold, c.cls,
   coalesce((SELECT sum(n) FROM {src} x WHERE x.model = c.model AND x.fold = c.fold AND x.label = c.cls AND x.prediction = c.cls), 0) AS tp,
   coalesce((SELECT sum(n) FROM {src} x WHERE x.model = c.model AND x.fold = c.fold AND x.label = c.cls), 0) AS support,
   coalesce((SELECT sum(n) FROM {src} x WHERE x.model = c.model AND x.fold = c.fold AND x.prediction = c.cls), 0) AS pred_n FROM {name}_cls c),
{name}_m AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0::DOUBLE END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0::DOUBLE END AS r FROM {name}_pc),
{name} AS (SELECT model, fold, sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END * support) / sum(support) AS f1 FROM {name}_m GROUP BY model, fold)"""


@register("a18_fold_statistics", _fold_sql() + f"""
SELECT model, {r6('avg(train_f1)')} AS mean_train_f1, {r6('avg(valid_f1)')} AS mean_valid_f1, {r6('max(valid_f1)')} AS best_valid_f1
FROM fsc GROUP BY model""")
def a18_fold_statistics(spark, sf_dir):
    fs = _fold_scores(spark, sf_dir)
    return round_doubles(fs.groupBy("model").agg(F.avg("train_f1").alias("mean_train_f1"), F.avg("valid_f1").alias("mean_valid_f1"),
                                                 F.max("valid_f1").alias("best_valid_f1")))


def early_stop(scores_sorted, patience: int, min_delta: float):
    """W8 as a higher-order fold over (fold, score) structs sorted by fold:
    an improvement needs score > best + min_delta; ``best`` moves only on an
    accepted improvement; stop at the first fold where misses reach
    patience."""
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("miss"),
                    F.lit(None).cast("int").alias("stop"), F.lit(0).alias("used"))

    def step(acc, x):
        stopped = acc.getField("stop").isNotNull()
        improve = acc.getField("best").isNull() | (x.getField("score") > acc.getField("best") + F.lit(min_delta))
        best = F.when(stopped, acc.getField("best")).when(improve, x.getField("score")).otherwise(acc.getField("best"))
        miss = F.when(stopped, acc.getField("miss")).when(improve, F.lit(0)).otherwise(acc.getField("miss") + 1)
        stop = F.when(stopped, acc.getField("stop")).when(miss >= patience, x.getField("fold"))
        used = F.when(stopped, acc.getField("used")).otherwise(acc.getField("used") + 1)
        return F.struct(best.alias("best"), miss.alias("miss"), stop.cast("int").alias("stop"), used.alias("used"))
    return F.aggregate(scores_sorted, init, step)


@register("w8_early_stopping", _fold_sql() + f""",
seq AS (SELECT model, list(valid_f1 ORDER BY fold) AS sc FROM fsc GROUP BY model),
st AS (SELECT model, list_reduce(list_prepend({{'best': NULL::DOUBLE, 'miss': 0, 'stop': NULL::INTEGER, 'used': 0}},
   list_transform(generate_series(0, len(sc) - 1), lambda i: {{'best': sc[i + 1], 'miss': -1, 'stop': CAST(i AS INTEGER), 'used': 0}})),
   lambda acc, x: CASE
     WHEN acc.stop IS NOT NULL THEN acc
     WHEN acc.best IS NULL OR x.best > acc.best + {_sql_dbl(lx.EARLY_STOP_MIN_DELTA)} THEN {{'best': x.best, 'miss': 0, 'stop': NULL::INTEGER, 'used': acc.used + 1}}
     WHEN acc.miss + 1 >= {lx.EARLY_STOP_PATIENCE} THEN {{'best': acc.best, 'miss': acc.miss + 1, 'stop': x.stop, 'used': acc.used + 1}}
     ELSE {{'best': acc.best, 'miss': acc.miss + 1, 'stop': NULL::INTEGER, 'used': acc.used + 1}} END) AS r FROM seq)
SELECT model, {r6('r.best')} AS best_score, r.stop AS stop_fold, r.used AS folds_used FROM st""")
def w8_early_stopping(spark, sf_dir):
    fs = _fold_scores(spark, sf_dir)
    # One short list per model (its fold scores): bounded by the fold count.
    seq = fs.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("fold", F.col("valid_f1").alias("score")))).alias("sc"))
    r = seq.select("model", early_stop(F.col("sc"), lx.EARLY_STOP_PATIENCE, lx.EARLY_STOP_MIN_DELTA).alias("r"))
    return round_doubles(r.select("model", F.col("r.best").alias("best_score"), F.col("r.stop").alias("stop_fold"),
                                  F.col("r.used").alias("folds_used")))
