"""Dataset operators: validation, preprocessing, label mapping, class counts,
de-duplication and unions (P*, A1-A3, W4, U*)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..functions import lexicon as lx
from ..sources.tables import table

LABELS = [0, 1, 2]


def label_from_flags(quality="quality", toxic="toxic") -> Column:
    """Class label of a labelled document: toxic -> 0, else quality -> 2,
    else 1."""
    q, t = F.col(quality), F.col(toxic)
    return F.when(t == 1, 0).when(q == 1, 2).otherwise(1).cast("int")


def labelled_documents(spark: SparkSession, sf_dir: str, how: str = "inner", with_text: bool = True) -> DataFrame:
    """documents joined to labels on doc_id with the 3-class label.

    ``labels`` is a fraction of ``documents``; the join is a shuffle join on
    doc_id at scale (AQE turns it into a broadcast when the runtime size of
    labels is small)."""
    docs = table(spark, sf_dir, "documents", spread_text=with_text)
    if not with_text:
        docs = docs.drop("text")
    labels = table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id", how)
    return df.withColumn("label", F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(),
                                         label_from_flags()))


def coerce_label(c, accept_names: bool = True) -> Column:
    """P1 label coercion: numeric text -> truncated int, kept when in {0,1,2}.

    Names (negative/neutral/positive, any case) are accepted first when
    ``accept_names`` (the documented CSV form); otherwise they are dropped
    like any other non-numeric value."""
    c = F.col(c) if isinstance(c, str) else c
    s = tx.py_strip(c.cast("string"))
    num = s.try_cast("double")
    as_int = F.when(num.isNotNull() & ~F.isnan(num) & (F.abs(num) < 2147483648.0), num.cast("int"))
    if accept_names:
        low = F.lower(s)
        named = F.when(low == "negative", 0).when(low == "neutral", 1).when(low == "positive", 2)
        as_int = F.coalesce(named, as_int)
    return F.when(as_int.isin(LABELS), as_int)


def fine_to_sentiment(c) -> Column:
    """Fine emotion id -> sentiment."""
    c = F.col(c) if isinstance(c, str) else c
    pos = list(lx.EMOTION_LABELS["POSITIVE"].keys())
    neg = list(lx.EMOTION_LABELS["NEGATIVE"].keys())
    return F.when(c.isin(pos), 2).when(c.isin(neg), 0).otherwise(1).cast("int")


def emotion_name_to_sentiment(c) -> Column:
    """Emotion name -> sentiment (null when unknown)."""
    m = F.create_map(*[x for k, v in lx.EMOTION_TO_SENTIMENT.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.col(c) if isinstance(c, str) else c)


def rating_to_sentiment(c) -> Column:
    """>3 -> 2, <3 -> 0, otherwise (null included) 1."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 3, 2).when(c < 3, 0).otherwise(1).cast("int")


def sentiment_name(c, lang: str = "en", unknown: str = "Unknown") -> Column:
    """P10: sentiment code -> name; unknown codes -> ``unknown``."""
    names = lx.SENTIMENT_NAMES_VI if lang == "vi" else lx.SENTIMENT_NAMES
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.element_at(m, c), F.lit(unknown))


def validate(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Trimmed text, coerced label, rows with a valid label only."""
    missing = [c for c in (text_col, label_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return (df.withColumn(text_col, tx.py_strip(F.col(text_col).cast("string")))
              .withColumn(label_col, coerce_label(label_col, accept_names=False))
              .filter(F.col(label_col).isNotNull()))


def preprocess(df: DataFrame, lang: str = "en", text_col: str = "text",
               compat_stop_words: bool = False, min_len: int = 3,
               accept_label_names: bool = True) -> DataFrame:
    """P2 + P3 + P6 + P7: clean, drop short texts, settle the label.

    The label branch is chosen from the schema at plan time."""
    if text_col not in df.columns:
        raise ValueError("No 'text' column found")
    out = (df.filter(F.col(text_col).isNotNull())
             .withColumn("cleaned_text", tx.clean_text(F.col(text_col).cast("string"), lang, compat_stop_words))
             .filter(F.length("cleaned_text") > min_len))
    if "label" in df.columns:
        out = (out.withColumn("label", coerce_label("label", accept_label_names))
                  .filter(F.col("label").isNotNull()))
    elif "sentiment" in df.columns:
        out = out.withColumn("label", fine_to_sentiment("sentiment")).drop("sentiment")
    else:
        out = out.withColumn("label", F.lit(1))
    return out


def class_counts(df: DataFrame, label_col: str = "label", labels=LABELS) -> DataFrame:
    """A1: rows per class, absent classes as 0 (a zero row per class is
    unioned in before the final aggregate; no join). The aggregation is
    partial (map-side) before its shuffle."""
    spark = df.sparkSession
    zeros = spark.createDataFrame([(x, 0) for x in labels], f"{label_col} INT, n BIGINT")
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return (counts.unionByName(zeros).groupBy(label_col).agg(F.sum("n").cast("bigint").alias("n"))
                  .filter(F.col(label_col).isin(list(labels))))


def class_proportions(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A2: class share; the total comes from a second tiny aggregate."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # The window runs over the aggregated table (one row per class).
    return counts.select(label_col, F.col("n").cast("bigint").alias("n"),
                         (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def hashed_keys(df: DataFrame, keys: list[str]) -> list[Column]:
    """Grouping keys that stand for the columns: 128-bit digests of strings, so
    that no text is a shuffle key, and other columns as they are."""
    kinds = dict(df.dtypes)
    return [(F.md5(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(f"_k{i}") for i, c in enumerate(keys)]


def dedup_keep_first(df: DataFrame, key_cols, order_col: str, keep: list[str] | None = None) -> DataFrame:
    """The row (or its columns ``keep``) with the smallest ``order_col`` per
    key; deterministic, unlike dropDuplicates. Keys are grouped by digest, and
    partial aggregation runs before the shuffle, so a hot key costs one row per
    map task, not all its copies."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    keep = keep or df.columns
    picked = df.groupBy(*hashed_keys(df, keys)).agg(F.min_by(F.struct(*keep), F.col(order_col)).alias("_r"))
    return picked.select("_r.*")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, grouped by the digests of their texts."""
    return df.groupBy(*hashed_keys(df, df.columns)).agg(F.first(F.struct(*df.columns)).alias("_r")).select("_r.*")


def features_and_labels(df: DataFrame, text_col: str = "cleaned_text", label_col: str = "label") -> DataFrame:
    """P5: rows with a valid label, projected to (text, label); raises when
    none is valid (a one-row probe, not a count)."""
    out = df.filter(F.col(label_col).isin(LABELS)).select(text_col, label_col)
    if out.isEmpty():
        raise ValueError("no rows with a valid label")
    return out
