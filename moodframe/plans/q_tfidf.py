"""Queries for TF-IDF vocabularies/weights, naive Bayes (aggregate form)
and chi^2 scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dataset as ds
from ..operators import sampling as sm
from ..operators import tfidf as tf
from ..session import materialize
from ..sources.tables import table
from .registry import register
from .sqlparts import LABELLED_DOCS, r6, round_doubles

TOK_SQL = r"regexp_extract_all(strip_accents(lower(text)), '([\p{L}\p{N}_]+)', 1)"


def _word_grams_sql(n_max):
    parts = ["list_transform(range(0, len(toks)), lambda i: toks[i + 1])"]
    if n_max >= 2:
        parts.append("list_transform(range(0, greatest(len(toks) - 1, 0)), lambda i: toks[i + 1] || ' ' || toks[i + 2])")
    if n_max >= 3:
        parts.append("list_transform(range(0, greatest(len(toks) - 2, 0)), lambda i: toks[i + 1] || ' ' || toks[i + 2] || ' ' || toks[i + 3])")
    expr = parts[0]
    for p in parts[1:]:
        expr = f"list_concat({expr}, {p})"
    return expr


def _char_grams_sql():
    t = f"regexp_replace(lower(text), '[{tx.WS}]{{2,}}', ' ', 'g')"
    parts = [f"list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n}))" for n in (2, 3, 4)]
    return t, f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})"


def _vocab_sql(grams_cte: str, k: int, min_df: int, max_df: float) -> str:
    return f"""{grams_cte},
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
st AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM c GROUP BY term),
v AS (SELECT term, df, ctf, ln((1.0 + (SELECT n FROM nd)) / (1.0 + df)) + 1.0 AS idf FROM st
      WHERE df >= {min_df} AND df <= {max_df} * (SELECT n FROM nd) ORDER BY ctf DESC, term LIMIT {k}),
w AS (SELECT c.doc_id, c.term, c.tf * v.idf AS w FROM c JOIN v ON v.term = c.term),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"""


def _word_cte(n_max):
    return f"""WITH t AS (SELECT doc_id, {TOK_SQL} AS toks FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest({_word_grams_sql(n_max)}) AS term FROM t)"""


def _char_cte():
    t = f"regexp_replace(lower(text), '[{tx.WS}]{{2,}}', ' ', 'g')"
    pos = " UNION ALL ".join(
        f"SELECT doc_id, t, {n} AS n, unnest(range(1, length(t) - {n} + 2)) AS i FROM t0" for n in (2, 3, 4))
    return f"""WITH t0 AS (SELECT doc_id, {t} AS t FROM documents WHERE text IS NOT NULL),
p AS ({pos}),
g AS (SELECT doc_id, substring(t, i, n) AS term FROM p)"""


WEIGHTS_SELECT = f"SELECT w.doc_id, w.term, {r6('w.w / nm.norm')} AS weight FROM w JOIN nm ON nm.doc_id = w.doc_id"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text")


def word_model(spark, sf_dir, n_max=3, k=2000, min_df=2, max_df=0.95):
    """The counts of vocabulary terms, and the vocabulary: a small table, written
    once because several steps read it."""
    docs = _docs(spark, sf_dir)
    toks = docs.select("doc_id", tf.word_tokens(F.col("text")).alias("toks"))
    vocab = materialize(tf.word_vocabulary(toks, F.col("toks"), docs.count(), k, min_df, max_df, n_max), "word-vocabulary")
    return tf.term_counts(toks, "doc_id", F.col("toks"), vocab), vocab


def char_model(spark, sf_dir, k=500):
    docs = _docs(spark, sf_dir)
    vocab = materialize(tf.char_vocabulary(docs, F.col("text"), docs.count(), k), "char-vocabulary")
    return tf.term_counts(docs, "doc_id", tf.squeezed(F.col("text")), vocab), vocab


@register("m1_word_tfidf", _vocab_sql(_word_cte(3), 2000, 2, 0.95) + "\n" + WEIGHTS_SELECT)
def m1_word_tfidf(spark, sf_dir):
    counts, _ = word_model(spark, sf_dir)
    return round_doubles(tf.tfidf_weights(counts, "doc_id").select("doc_id", "term", "weight"))


@register("m2_fallback_word_tfidf", _vocab_sql(_word_cte(2), 1000, 1, 1.0) + "\n" + WEIGHTS_SELECT)
def m2_fallback_word_tfidf(spark, sf_dir):
    counts, _ = word_model(spark, sf_dir, n_max=2, k=1000, min_df=1, max_df=1.0)
    return round_doubles(tf.tfidf_weights(counts, "doc_id").select("doc_id", "term", "weight"))


@register("m3_char_tfidf", _vocab_sql(_char_cte(), 500, 1, 1.0) + "\n" + WEIGHTS_SELECT)
def m3_char_tfidf(spark, sf_dir):
    counts, _ = char_model(spark, sf_dir)
    return round_doubles(tf.tfidf_weights(counts, "doc_id").select("doc_id", "term", "weight"))


@register("t3_vocabulary_top_k", _vocab_sql(_word_cte(3), 2000, 2, 0.95) + f"""
SELECT term, CAST(df AS BIGINT) AS df, CAST(ctf AS BIGINT) AS ctf, {r6('idf')} AS idf FROM v""")
def t3_vocabulary_top_k(spark, sf_dir):
    _, vocab = word_model(spark, sf_dir)
    return round_doubles(vocab.select("term", F.col("df").cast("bigint"), F.col("ctf").cast("bigint"), "idf"))


def _split_sql():
    return f"""lab AS ({LABELLED_DOCS}),
rk AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42', 'split')), doc_id) AS rn,
       count(*) OVER (PARTITION BY label) AS nl FROM lab WHERE text IS NOT NULL),
tr AS (SELECT doc_id, label FROM rk WHERE rn > round(CAST(nl AS DOUBLE) * 0.3)),
te AS (SELECT doc_id, label FROM rk WHERE rn <= round(CAST(nl AS DOUBLE) * 0.3))"""


@register("m9_naive_bayes_sql_form", _vocab_sql(_word_cte(3), 2000, 2, 0.95) + ",\n" + _split_sql() + f""",
nv AS (SELECT count(*) AS V FROM v),
nct AS (SELECT tr.label, c.term, sum(c.tf) AS n_ct FROM c JOIN v ON v.term = c.term JOIN tr ON tr.doc_id = c.doc_id GROUP BY ALL),
cl AS (SELECT DISTINCT label FROM tr),
fl AS (SELECT cl.label, v.term, coalesce(nct.n_ct, 0) AS n_ct FROM cl JOIN v ON true LEFT JOIN nct ON nct.label = cl.label AND nct.term = v.term),
tot AS (SELECT label, sum(n_ct) AS n_c FROM fl GROUP BY label),
ll AS (SELECT fl.label, fl.term, ln(fl.n_ct + 0.8::DOUBLE) - ln(tot.n_c + 0.8::DOUBLE * (SELECT V FROM nv)) AS loglik
       FROM fl JOIN tot ON tot.label = fl.label),
pr AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS prior FROM tr GROUP BY label),
s AS (SELECT c.doc_id, ll.label, sum(c.tf * ll.loglik) AS s FROM c JOIN ll ON ll.term = c.term JOIN te ON te.doc_id = c.doc_id GROUP BY ALL),
sc AS (SELECT te.doc_id, pr.label, pr.prior + coalesce(s.s, 0.0) AS score FROM te JOIN pr ON true LEFT JOIN s ON s.doc_id = te.doc_id AND s.label = pr.label),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM sc)
SELECT doc_id, label AS prediction, {r6('score')} AS score FROM b WHERE r = 1""")
def m9_naive_bayes_sql_form(spark, sf_dir):
    counts, vocab = word_model(spark, sf_dir)
    counts = materialize(counts, "word-counts")         # read for the fit and for the prediction
    lab = ds.labelled_documents(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", "label")
    split = sm.stratified_split(lab)
    train = split.filter(F.col("split") == "train").select("doc_id", "label")
    test = split.filter(F.col("split") == "test").select("doc_id")
    priors, loglik = tf.nb_fit(counts, train, "doc_id", vocab, alpha=0.8)
    test_counts = counts.join(test, "doc_id", "left_semi")
    return round_doubles(tf.nb_predict(test_counts, priors, loglik, "doc_id", test))


@register("m12_chi2_scores", _vocab_sql(_word_cte(3), 2000, 2, 0.95) + f""",
lab AS (SELECT doc_id, label FROM ({LABELLED_DOCS}) WHERE text IS NOT NULL),
sh AS (SELECT label, count(*) / (SELECT count(*) FROM lab) AS share FROM lab GROUP BY label),
ob AS (SELECT lab.label, c.term, sum(c.tf) AS obs FROM c JOIN v ON v.term = c.term JOIN lab ON lab.doc_id = c.doc_id GROUP BY ALL),
ft AS (SELECT term, sum(obs) AS ftot FROM ob GROUP BY term),
fl AS (SELECT sh.label, v.term, coalesce(ob.obs, 0) AS obs, sh.share * ft.ftot AS exp FROM sh JOIN v ON true
       LEFT JOIN ob ON ob.label = sh.label AND ob.term = v.term JOIN ft ON ft.term = v.term)
SELECT term, {r6('sum((obs - exp) * (obs - exp) / exp)')} AS chi2 FROM fl GROUP BY term""")
def m12_chi2_scores(spark, sf_dir):
    counts, vocab = word_model(spark, sf_dir)
    lab = ds.labelled_documents(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", "label")
    return round_doubles(tf.chi2_scores(counts, lab, vocab, "doc_id"))


@register("m12_mutual_information", _vocab_sql(_word_cte(3), 2000, 2, 0.95) + f""",
lab AS (SELECT doc_id, label FROM ({LABELLED_DOCS}) WHERE text IS NOT NULL),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lab),
cl AS (SELECT label, CAST(count(*) AS DOUBLE) AS n_c FROM lab GROUP BY label),
tc AS (SELECT lab.label, c.term, CAST(count(*) AS DOUBLE) AS n_tc FROM c JOIN v ON v.term = c.term JOIN lab ON lab.doc_id = c.doc_id GROUP BY ALL),
fl AS (SELECT v.term, cl.n_c, coalesce(tc.n_tc, 0) AS a, sum(coalesce(tc.n_tc, 0)) OVER (PARTITION BY v.term) AS n_t, n FROM cl JOIN v ON true
       LEFT JOIN tc ON tc.label = cl.label AND tc.term = v.term CROSS JOIN nn),
mi AS (SELECT term, sum(CASE WHEN a > 0 THEN a / n * ln(a * n / (n_t * n_c)) ELSE 0 END
  + CASE WHEN n_c - a > 0 THEN (n_c - a) / n * ln((n_c - a) * n / ((n - n_t) * n_c)) ELSE 0 END) AS mi FROM fl GROUP BY term)
SELECT term, {r6('mi')} AS mi FROM mi""")
def m12_mutual_information(spark, sf_dir):
    counts, vocab = word_model(spark, sf_dir)
    lab = ds.labelled_documents(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", "label")
    return round_doubles(tf.mutual_information(counts, lab, vocab, "doc_id").select("term", "mi"))
