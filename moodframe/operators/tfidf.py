"""TF-IDF vocabularies and weights, naive Bayes in aggregate form, chi^2
feature selection (M1-M3, M9, M12, T3).

Weights follow the smoothed form w = tf * (ln((1+n)/(1+df)) + 1), then L2
normalisation per document (Spark ML's IDF omits the +1, so the idf vector
is computed here and applied with ElementwiseProduct).

Scale notes: n-grams are counted by blocks of texts inside tasks (``grams``), the
vocabulary is the top-k of the sums; it is the only thing broadcast, its size
bounded by k. Counts by document are made for its terms alone, so a document
shuffles at most k rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..functions.text import WS
from . import grams as gr

WORD = r"[\p{L}\p{N}_]+"


def word_tokens(text: Column) -> Column:
    """Lower-case, strip accents (NFKD, drop marks), tokens of word chars."""
    return F.regexp_extract_all(tx.strip_accents(F.lower(text)), F.lit(f"({WORD})"), 1)


def word_ngrams(tokens: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """Word n-grams of a token array (tokens never contain spaces). n = 1 is
    the array itself; each longer n is one regex pass over the space-joined
    tokens: a zero-width lookahead at every token start captures the next n
    tokens (faster than slicing the array at every position)."""
    joined = F.array_join(tokens, " ")
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(tokens)
        else:
            pat = "(?:^| )(?=(" + " ".join(["[^ ]+"] * n) + "))"
            parts.append(F.regexp_extract_all(joined, F.lit(pat), 1))
    return F.concat(*parts)


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[{WS}]{{2,}}", " ")


def char_ngrams(text: Column, n_min: int = 2, n_max: int = 4) -> Column:
    """Character n-grams over the lower-cased text with whitespace runs of
    two or more collapsed to one space, across word borders. Each n is one
    regex pass: a zero-width lookahead captures the window at every
    position, so no per-position lambda re-reads the text."""
    t = squeezed(text)
    return F.concat(*[F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(n_min, n_max + 1)])


def term_stats(df: DataFrame, terms: Column) -> DataFrame:
    """(term, df, ctf): documents that hold the term, and its occurrences. A
    document brings its distinct terms and all its terms, so one partial
    aggregate by term gives both and no (document, term) row is shuffled."""
    g = df.select(terms.alias("_g"))
    twice = g.select(F.explode(F.array(F.struct(F.array_distinct("_g").alias("t"), F.lit(1).alias("d")), F.struct(F.col("_g").alias("t"), F.lit(0).alias("d")))).alias("x"))
    rows = twice.select(F.col("x.d").alias("d"), F.explode("x.t").alias("term"))
    return rows.groupBy("term").agg(F.sum("d").alias("df"), F.sum(1 - F.col("d")).alias("ctf"))


def word_vocabulary(df: DataFrame, tokens: Column, n_docs: int, k: int, min_df: int = 1, max_df: float = 1.0, n_max: int = 3) -> DataFrame:
    """``vocabulary`` of the word n-grams of 1 to ``n_max`` tokens."""
    max_count = max_df * n_docs if isinstance(max_df, float) else max_df
    stats = gr.common_word_stats(df, tokens, n_max, n_docs, k, min_df, max_count)
    return vocabulary(term_stats(df, word_ngrams(tokens, 1, n_max)) if stats is None else stats, n_docs, k, min_df, max_df)


def char_vocabulary(df: DataFrame, text: Column, n_docs: int, k: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """``vocabulary`` of the character n-grams of 2 to 4 characters."""
    return vocabulary(gr.character_stats(df, squeezed(text), 2, 4), n_docs, k, min_df, max_df)


def vocabulary(stats: DataFrame, n_docs: int, k: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(term, df, ctf, idx, idf) for the top-k terms by corpus frequency
    after the document-frequency bounds; ties by term ascending."""
    max_count = max_df * n_docs if isinstance(max_df, float) else max_df
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_count)))
    top = kept.orderBy(F.col("ctf").desc(), F.col("term")).limit(k)
    # The window runs over the k kept terms only.
    return top.select("term", "df", "ctf", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
                      (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def term_counts(df: DataFrame, key: str, values: Column, vocab: DataFrame) -> DataFrame:
    """(key, term, idx, idf, tf) for the terms of the vocabulary (k rows, a
    broadcast) in ``values``, tokens or texts: at most k rows a document are
    shuffled, by key, as the norms and joins need them."""
    listed = [r["term"] for r in vocab.select("term", "idx").orderBy("idx").collect()]
    words = dict(df.select(values.alias("v")).dtypes)["v"].startswith("array")
    found = gr.term_rows(df, key, values, gr.word_terms(listed) if words else gr.character_terms(listed))
    sums = found.repartition(key).groupBy(key, "idx").agg(F.sum("tf").alias("tf"))
    return sums.join(F.broadcast(vocab.select("term", "idx", "idf")), "idx").select(key, "term", "idx", "idf", "tf")


def tfidf_weights(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, idx, weight): L2-normalised tf*idf; the norm is a sum over
    the at most k rows of a document."""
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy(key)))
    return counts.select(key, "term", "idx", (w / norm).alias("weight"))


def tfidf_stages(vocab_rows, input_col: str, output_col: str):
    """Spark ML stages reproducing the weights as sparse vectors:
    CountVectorizerModel (fixed vocabulary) -> idf product -> L2 norm."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rows = sorted(vocab_rows, key=lambda r: r["idx"])
    cv = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol=input_col, outputCol=output_col + "_tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol=output_col + "_tf",
                            outputCol=output_col + "_raw")
    nm = Normalizer(p=2.0, inputCol=output_col + "_raw", outputCol=output_col)
    return [cv, ep, nm]


# ---- naive Bayes (aggregate form) --------------------------------------------------

def _class_shares(labels: DataFrame, label_col: str) -> list[tuple[int, int]]:
    """(class, rows) pairs; one row per class, so it may reach the driver."""
    return [(r[0], r[1]) for r in labels.groupBy(label_col).agg(F.count(F.lit(1))).orderBy(label_col).collect()]


def _with_classes(df: DataFrame, classes: list[int], label_col: str) -> DataFrame:
    return df.withColumn(label_col, F.explode(F.array(*[F.lit(c) for c in classes])))


def nb_fit(train_counts: DataFrame, labels: DataFrame, key: str, vocab: DataFrame, alpha: float = 0.8,
           label_col: str = "label") -> tuple[dict, DataFrame]:
    """Multinomial NB from counts: priors log(n_c / n), likelihoods
    log((N_ct + a) / (N_c + a V)). Returns ({class: prior}, loglik table of
    classes x vocabulary rows)."""
    import math
    shares = _class_shares(labels, label_col)
    n = sum(c for _, c in shares)
    priors = {k: math.log(c / n) for k, c in shares}
    v_size = vocab.count()
    c = train_counts.join(labels.select(key, label_col), key)
    n_ct = c.groupBy(label_col, "term").agg(F.sum("tf").alias("n_ct"))
    full = (_with_classes(vocab.select("term"), list(priors), label_col)
            .join(n_ct, [label_col, "term"], "left").fillna(0, ["n_ct"]))
    tot = full.groupBy(label_col).agg(F.sum("n_ct").alias("n_c"))
    loglik = full.join(F.broadcast(tot), label_col).select(
        label_col, "term", (F.log(F.col("n_ct") + alpha) - F.log(F.col("n_c") + alpha * v_size)).alias("loglik"))
    return priors, loglik


def nb_predict(counts: DataFrame, priors: dict, loglik: DataFrame, key: str, keys: DataFrame,
               label_col: str = "label") -> DataFrame:
    """Joint log-likelihood per (doc, class) and arg-max (ties -> smallest
    class). Documents with no vocabulary term score by the prior alone."""
    pm = F.create_map(*[x for k, v in priors.items() for x in (F.lit(k), F.lit(v))])
    s = counts.join(F.broadcast(loglik), "term").groupBy(key, label_col).agg(F.sum(F.col("tf") * F.col("loglik")).alias("_s"))
    grid = _with_classes(keys.select(key), list(priors), label_col)
    jl = grid.join(s, [key, label_col], "left").select(
        key, label_col, (F.element_at(pm, F.col(label_col)) + F.coalesce("_s", F.lit(0.0))).alias("score"))
    best = jl.groupBy(key).agg(F.max_by(F.struct(F.col(label_col), F.col("score")),
                                        F.struct(F.col("score"), -F.col(label_col))).alias("b"))
    return best.select(key, F.col("b").getField(label_col).alias("prediction"), F.col("b.score").alias("score"))


def chi2_scores(counts: DataFrame, labels: DataFrame, vocab: DataFrame, key: str, label_col: str = "label") -> DataFrame:
    """chi^2 of each vocabulary term against the class, on counts:
    observed = counts per class, expected = class share x term total."""
    shares = _class_shares(labels, label_col)
    n = float(sum(c for _, c in shares))
    sm = F.create_map(*[x for k, c in shares for x in (F.lit(k), F.lit(c / n))])
    c = counts.join(labels.select(key, label_col), key)
    obs = c.groupBy(label_col, "term").agg(F.sum("tf").alias("obs"))
    ftot = obs.groupBy("term").agg(F.sum("obs").alias("ftot"))
    full = (_with_classes(vocab.select("term"), [k for k, _ in shares], label_col)
            .join(obs, [label_col, "term"], "left").fillna(0, ["obs"]).join(ftot, "term"))
    full = full.withColumn("exp", F.element_at(sm, F.col(label_col)) * F.col("ftot"))
    return full.groupBy("term").agg(F.sum((F.col("obs") - F.col("exp")) ** 2 / F.col("exp")).alias("chi2"))


def mutual_information(counts: DataFrame, labels: DataFrame, vocab: DataFrame, key: str, label_col: str = "label") -> DataFrame:
    """Mutual information (nats) of a term's presence in a document and the
    class, from the joint document counts."""
    shares = dict(_class_shares(labels, label_col))
    n = float(sum(shares.values()))
    size = F.create_map(*[x for k, c in shares.items() for x in (F.lit(k), F.lit(float(c)))])
    with_term = counts.join(labels.select(key, label_col), key).groupBy(label_col, "term").agg(F.count(F.lit(1)).cast("double").alias("n_tc"))
    full = (_with_classes(vocab.select("term"), list(shares), label_col)
            .join(with_term, [label_col, "term"], "left").fillna(0.0, ["n_tc"]).withColumn("n_c", F.element_at(size, F.col(label_col))))
    # a window of as many rows as there are classes
    full = full.withColumn("n_t", F.sum("n_tc").over(Window.partitionBy("term")))

    def part(joint: Column, of_term: Column) -> Column:
        return F.when(joint > 0, joint / n * F.log(joint * n / (of_term * F.col("n_c")))).otherwise(F.lit(0.0))
    mi = part(F.col("n_tc"), F.col("n_t")) + part(F.col("n_c") - F.col("n_tc"), n - F.col("n_t"))
    return full.groupBy("term").agg(F.sum(mi).alias("mi"))


def select_features(scores: DataFrame, k: int, score: str) -> DataFrame:
    """The k terms of the highest score, ties by term."""
    return scores.orderBy(F.col(score).desc(), "term").limit(k)
