"""Evaluation and voting.

Every metric is computed from one partial aggregation of the scored rows
into a (label, prediction, n) table of at most classes^2 rows; everything
after that runs on that tiny table. AUC groups equal scores first and uses a
two-level cumulative sum (score-bucket totals, then inside each
(class, bucket)), so no window spans a whole class.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window



# ---- voting ---------------------------------------------------------------------

def hard_vote(preds: list[Column], labels=(0, 1, 2)) -> Column:
    """Most frequent prediction; ties -> smallest label."""
    cands = [F.struct(sum((p == F.lit(c)).cast("int") for p in preds).alias("cnt"), F.lit(-c).alias("neg"))
             for c in labels]
    return (-F.array_max(F.array(*cands)).getField("neg")).cast("int")


def soft_vote(probs: list[Column], weights=None) -> Column:
    """(weighted) mean of per-model probability arrays."""
    weights = weights or [1.0 / len(probs)] * len(probs)
    acc = None
    for p, w in zip(probs, weights):
        term = F.transform(p, lambda x: x * F.lit(float(w)))
        acc = term if acc is None else F.zip_with(acc, term, lambda a, b: a + b)
    return acc


def sigmoid_normalise(decision: Column) -> Column:
    """Y3 + Y4: sigmoid of decision values, normalised to sum 1."""
    sig = F.transform(decision, lambda x: 1.0 / (1.0 + F.exp(-x)))
    total = F.aggregate(sig, F.lit(0.0), lambda a, x: a + x)
    return F.transform(sig, lambda x: x / total)


# ---- confusion-derived metrics ---------------------------------------------------

def confusion_counts(df: DataFrame, label_col="label", pred_col="prediction", by=()) -> DataFrame:
    return df.groupBy(*by, F.col(label_col).alias("label"), F.col(pred_col).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label_col="label", pred_col="prediction", labels=(0, 1, 2)) -> DataFrame:
    """A4: one row per true label, one column per predicted label."""
    cc = confusion_counts(df, label_col, pred_col)
    piv = cc.groupBy("label").pivot("prediction", list(labels)).agg(F.sum("n"))
    return piv.select("label", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in labels])


def per_class(cc: DataFrame, by=()) -> DataFrame:
    """Per-class tp, support, predicted count, precision, recall, f1 from a
    confusion-count table (zero division -> 0): one aggregate over a row per
    label and a row per prediction. Null groups and a null class count like others."""
    by = list(by)
    none = F.lit(0).cast("long")
    own = F.struct(F.col("label").alias("cls"), F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(none).alias("tp"), F.col("n").alias("support"), none.alias("pred_n"))
    said = F.struct(F.col("prediction").alias("cls"), none.alias("tp"), none.alias("support"), F.col("n").alias("pred_n"))
    t = cc.select(*by, F.explode(F.array(own, said)).alias("x")).select(*by, "x.*")
    t = t.groupBy(*by, "cls").agg(*(F.sum(c).alias(c) for c in ("tp", "support", "pred_n")))
    p = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return t.withColumn("f1", f1)


def classification_report(df: DataFrame, label_col="label", pred_col="prediction") -> DataFrame:
    """A5: per-class rows + accuracy + macro avg + weighted avg."""
    pc = per_class(confusion_counts(df, label_col, pred_col))
    classes = pc.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                        F.col("support").cast("bigint").alias("support"))
    tot = pc.agg(F.sum("support").alias("s"), F.sum("tp").alias("tp"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 F.sum(F.col("precision") * F.col("support")).alias("wp"),
                 F.sum(F.col("recall") * F.col("support")).alias("wr"),
                 F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("s")).alias("f1"),
                     F.col("s").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("s").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), (F.col("wp") / F.col("s")).alias("precision"),
                          (F.col("wr") / F.col("s")).alias("recall"), (F.col("wf") / F.col("s")).alias("f1"),
                          F.col("s").cast("bigint").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def grouped_scores(df: DataFrame, by: list[str], label_col="label", pred_col="prediction") -> DataFrame:
    """Accuracy, weighted precision, weighted recall, weighted F1 per group."""
    pc = per_class(confusion_counts(df, label_col, pred_col, by), by)
    return pc.groupBy(*by).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")))


def balanced_accuracy(df: DataFrame, label_col="label", pred_col="prediction") -> DataFrame:
    """Mean recall over the classes present in the truth."""
    pc = per_class(confusion_counts(df, label_col, pred_col))
    return pc.filter(F.col("support") > 0).agg(F.avg("recall").alias("balanced_accuracy"))


def composite_scores(df: DataFrame, label_col="label", pred_col="prediction", weights=None) -> DataFrame:
    """0.4*P + 0.4*R + 0.2*F1 per class, with precision's zero division
    counted as 1."""
    w = weights or {"precision": 0.4, "recall": 0.4, "f1": 0.2}
    pc = per_class(confusion_counts(df, label_col, pred_col))
    p = F.when(F.col("pred_n") > 0, F.col("precision")).otherwise(F.lit(1.0))
    r = F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return pc.select(F.col("cls").alias("label"), p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                     (F.lit(w["precision"]) * p + F.lit(w["recall"]) * r + F.lit(w["f1"]) * f1).alias("composite"))


def accuracy(df: DataFrame, label_col="label", pred_col="prediction") -> DataFrame:
    """Mean of (prediction = label)."""
    return df.agg(F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def error_analysis(df: DataFrame, label_col="label", pred_col="prediction") -> DataFrame:
    """Count of each (true, predicted) error pair."""
    return (df.filter(F.col(label_col) != F.col(pred_col))
              .groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("prediction"))
              .agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, value: Column, width: float, name: str = "bucket") -> DataFrame:
    """Equal-width buckets floor(value / width) with counts."""
    return df.groupBy(F.floor(value / F.lit(width)).cast("bigint").alias(name)).agg(F.count(F.lit(1)).alias("n"))


# ---- ROC / AUC ---------------------------------------------------------------------

def _score_table(df: DataFrame, label_col: str, score_col: str, classes) -> DataFrame:
    """(cls, score, pos, neg): one row per class and distinct score. A row
    without a score for a class wasn't scored for it and isn't on its curve."""
    rows = df.select(F.col(label_col).alias("_y"), F.posexplode(F.col(score_col)).alias("cls", "score"))
    rows = rows.filter(F.col("cls").isin(list(classes)) & F.col("score").isNotNull())
    return rows.groupBy("cls", "score").agg(
        F.sum(F.col("_y").eqNullSafe(F.col("cls")).cast("long")).alias("pos"),
        F.sum((~F.col("_y").eqNullSafe(F.col("cls"))).cast("long")).alias("neg"))


def _cumulative_neg_below(st: DataFrame, buckets: int) -> DataFrame:
    """neg_below = negatives with a smaller score, per class. Scores are
    probabilities in [0,1]; floor(score*buckets) is monotone in score, so
    bucket totals give the prefix before each bucket and a window inside
    each (class, bucket) finishes it."""
    st = st.withColumn("_bk", F.least(F.floor(F.col("score") * buckets), F.lit(buckets - 1)))
    bt = st.groupBy("cls", "_bk").agg(F.sum("neg").alias("_bneg"), F.sum("pos").alias("_bpos"))
    wb = Window.partitionBy("cls").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select("cls", "_bk", F.coalesce(F.sum("_bneg").over(wb), F.lit(0)).alias("_neg_before"),
                   F.coalesce(F.sum("_bpos").over(wb), F.lit(0)).alias("_pos_before"))
    wi = Window.partitionBy("cls", "_bk").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    st = st.join(F.broadcast(bt), ["cls", "_bk"])
    return (st.withColumn("neg_below", F.col("_neg_before") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
              .withColumn("pos_below", F.col("_pos_before") + F.coalesce(F.sum("pos").over(wi), F.lit(0))))


def ovr_auc(df: DataFrame, label_col="label", score_col="probs", classes=(0, 1, 2), buckets: int = 1024) -> DataFrame:
    """One-vs-rest ROC AUC per class, ties counted as one half; null for a
    class that all rows or no rows have."""
    st = _cumulative_neg_below(_score_table(df, label_col, score_col, classes), buckets)
    return st.groupBy("cls").agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)), F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, label_col="label", score_col="probs", classes=(0, 1, 2), buckets: int = 1024) -> DataFrame:
    """A8 curve: for each class and distinct score threshold t, the TPR and
    FPR of predicting positive when score >= t."""
    st = _cumulative_neg_below(_score_table(df, label_col, score_col, classes), buckets)
    tot = st.groupBy("cls").agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    st = st.join(F.broadcast(tot), "cls")
    return st.select("cls", F.col("score").alias("threshold"),
                     F.try_divide(F.col("_P") - F.col("pos_below"), F.col("_P")).alias("tpr"),
                     F.try_divide(F.col("_N") - F.col("neg_below"), F.col("_N")).alias("fpr"))
