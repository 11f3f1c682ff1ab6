"""Queries for augmentation and synthesis over documents / labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import augment as ag
from ..operators import dataset as ds
from ..operators import sampling as sm
from ..sources.tables import table
from .registry import register
from .sqlparts import LABELLED_DOCS


def _words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", "text", tx.split_ws(F.col("text")).alias("w"))


W_SQL = f"SELECT doc_id, text, {tx.sql_split_ws('text')} AS w FROM documents WHERE text IS NOT NULL"


def _u(salt, k="0"):
    return hz.sql_u01("doc_id", 42, salt, k)


def _pick(n, salt):
    return hz.sql_pick_index(n, "doc_id", 42, salt)


@register("g3_random_swap", f"""WITH d AS ({W_SQL}),
p AS (SELECT *, len(w) AS n, {_pick('len(w)', 'g3a')} AS a, {_pick('len(w) - 1', 'g3b')} AS b0 FROM d),
q AS (SELECT *, least(a, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END) AS i, greatest(a, CASE WHEN b0 >= a THEN b0 + 1 ELSE b0 END) AS j FROM p)
SELECT doc_id, md5(CASE WHEN n >= 2 THEN array_to_string(list_concat(list_concat(list_concat(list_concat(w[1:i], [w[j + 1]]), w[i + 2:j]), [w[i + 1]]), w[j + 2:]), ' ')
  ELSE array_to_string(w, ' ') END) AS aug_md5 FROM q""")
def g3_random_swap(spark, sf_dir):
    d = _words(spark, sf_dir)
    return d.select("doc_id", F.md5(F.array_join(ag.random_swap(F.col("w"), F.col("doc_id")), " ")).alias("aug_md5"))


@register("g4_random_deletion", f"""WITH d AS ({W_SQL}),
k AS (SELECT *, list_filter(w, lambda x, i: {hz.sql_u01('doc_id', 42, 'g4', 'i - 1')} > 0.1) AS kept FROM d)
SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= 1 THEN w WHEN len(kept) = 0 THEN [w[{_pick('len(w)', 'g4r')} + 1]] ELSE kept END, ' ')) AS aug_md5 FROM k""")
def g4_random_deletion(spark, sf_dir):
    d = _words(spark, sf_dir)
    return d.select("doc_id", F.md5(F.array_join(ag.random_deletion(F.col("w"), F.col("doc_id")), " ")).alias("aug_md5"))


@register("g1_synonym_replacement", f"""WITH d AS ({W_SQL}),
k AS (SELECT *, list_filter(list_distinct_ordered, lambda x: list_contains({lx.sql_str_list(list(ag.SYNONYMS))}, x)) AS known FROM
  (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM d)),
c AS (SELECT *, known[{_pick('len(known)', 'g1w')} + 1] AS cw FROM k),
s AS (SELECT *, CASE cw {' '.join(f"WHEN '{a}' THEN {lx.sql_str_list(b)}" for a, b in ag.SYNONYMS.items())} END AS syns,
      list_filter(range(0, len(w)), lambda i: w[i + 1] = cw) AS pos FROM c),
r AS (SELECT *, syns[{_pick('len(syns)', 'g1s')} + 1] AS syn, pos[{_pick('len(pos)', 'g1p')} + 1] AS idx FROM s)
SELECT doc_id, md5(CASE WHEN len(known) > 0 THEN array_to_string(list_concat(list_concat(w[1:idx], [syn]), w[idx + 2:]), ' ')
  ELSE array_to_string(w, ' ') END) AS aug_md5 FROM r""")
def g1_synonym_replacement(spark, sf_dir):
    d = ag.synonym_replacement(_words(spark, sf_dir), "w", "doc_id", "aug")
    return d.select("doc_id", F.md5(F.array_join("aug", " ")).alias("aug_md5"))


@register("g2_random_insertion", f"""WITH d AS ({W_SQL}),
k AS (SELECT *, {lx.sql_str_list(list(ag.SYNONYMS))}[{_pick(str(len(ag.SYNONYMS)), 'g2k')} + 1] AS kw FROM d),
s AS (SELECT *, CASE kw {' '.join(f"WHEN '{a}' THEN {lx.sql_str_list(b)}" for a, b in ag.SYNONYMS.items())} END AS syns FROM k),
r AS (SELECT *, syns[{_pick('len(syns)', 'g2s')} + 1] AS syn, {_pick('len(w) + 1', 'g2i')} AS idx FROM s)
SELECT doc_id, md5(array_to_string(list_concat(list_concat(w[1:idx], [syn]), w[idx + 1:]), ' ')) AS aug_md5 FROM r""")
def g2_random_insertion(spark, sf_dir):
    d = _words(spark, sf_dir)
    return d.select("doc_id", F.md5(F.array_join(ag.random_insertion(F.col("w"), F.col("doc_id")), " ")).alias("aug_md5"))


@register("g5_template_based", f"""SELECT doc_id, md5(replace({lx.sql_str_list(ag.TEMPLATES['en'])}[{_pick('5', 'g5')} + 1], '{{text}}', text)) AS aug_md5
FROM documents WHERE text IS NOT NULL""")
def g5_template_based(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.md5(ag.template_based(F.col("text"), F.col("doc_id"))).alias("aug_md5"))


SYN_CASE = "CASE {} " + " ".join(f"WHEN '{a}' THEN {lx.sql_str_list(b)}" for a, b in ag.SYNONYMS.items()) + " END"

G7_SQL = f"""WITH d AS (SELECT doc_id, label, text, {tx.sql_split_ws('text')} AS w FROM ({LABELLED_DOCS}) WHERE text IS NOT NULL),
k AS (SELECT *, list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: list_contains({lx.sql_str_list(list(ag.SYNONYMS))}, x)) AS known FROM d),
c AS (SELECT *, known[{_pick('len(known)', 'g1w')} + 1] AS cw, {lx.sql_str_list(list(ag.SYNONYMS))}[{_pick(str(len(ag.SYNONYMS)), 'g2k')} + 1] AS kw FROM k),
s AS (SELECT *, {SYN_CASE.format('cw')} AS syns, {SYN_CASE.format('kw')} AS syns2, list_filter(range(0, len(w)), lambda i: w[i + 1] = cw) AS pos FROM c),
r AS (SELECT *, pos[{_pick('len(pos)', 'g1p')} + 1] AS idx, {_pick('len(w) + 1', 'g2i')} AS gap FROM s)
SELECT doc_id, label, 0 AS variant, md5(text) AS text_md5 FROM d
UNION ALL SELECT doc_id, label, 1, md5(CASE WHEN len(known) > 0 THEN array_to_string(list_concat(list_concat(w[1:idx], [syns[{_pick('len(syns)', 'g1s')} + 1]]), w[idx + 2:]), ' ')
  ELSE array_to_string(w, ' ') END) FROM r
UNION ALL SELECT doc_id, label, 2, md5(array_to_string(list_concat(list_concat(w[1:gap], [syns2[{_pick('len(syns2)', 'g2s')} + 1]]), w[gap + 1:]), ' ')) FROM r"""


@register("g7_u4_augment_dataset", G7_SQL)
def g7_augment_dataset(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir).filter(F.col("text").isNotNull()).select("doc_id", "text", "label")
    a = ag.augment_rows(d, "doc_id", "text", n_per_sample=2)
    return a.select("doc_id", "label", "variant", F.md5("aug_text").alias("text_md5"))


@register("g6_method_list", f"""WITH d AS ({W_SQL}),
k AS (SELECT *, list_filter(w, lambda x, i: {hz.sql_u01('doc_id', 42, 'g4', 'i - 1')} > 0.1) AS kept FROM d)
SELECT doc_id, 1 AS variant, md5(replace({lx.sql_str_list(ag.TEMPLATES['en'])}[{_pick('5', 'g5')} + 1], '{{text}}', text)) AS text_md5 FROM d
UNION ALL SELECT doc_id, 2, md5(array_to_string(CASE WHEN len(w) <= 1 THEN w WHEN len(kept) = 0 THEN [w[{_pick('len(w)', 'g4r')} + 1]] ELSE kept END, ' ')) FROM k""")
def g6_method_list(spark, sf_dir):
    """Chosen methods in their order, an unknown one passed over."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text")
    a = ag.augment_rows(d, "doc_id", "text", 9, methods=["template", "unknown", "delete"])
    return a.where("variant > 0").select("doc_id", "variant", F.md5("aug_text").alias("text_md5"))


def _deco_sql(kind):
    if kind == "g10":
        parts = []
        for s, es in ag.EMOJIS.items():
            e = f"{lx.sql_str_list(es)}[{_pick(str(len(es)), 'g10e')} + 1]"
            parts.append(f"WHEN label = {s} AND {_u('g10')} <= 0.3 THEN CASE WHEN {_u('g10side')} < 0.5 THEN {e} || ' ' || t ELSE t || ' ' || {e} END")
        return "CASE " + " ".join(parts) + " ELSE t END"
    if kind == "g16":
        parts = []
        for s, xs in ag.EXPRESSIONS.items():
            x = f"{lx.sql_str_list(xs)}[{_pick(str(len(xs)), 'g16x')} + 1]"
            parts.append(f"WHEN label = {s} AND {_u('g16')} <= 0.3 THEN CASE WHEN {_u('g16side')} < 0.5 THEN {x} || ', ' || lower(t) ELSE t || '. ' || {x} END")
        return "CASE " + " ".join(parts) + " ELSE t END"
    parts = [f"WHEN label = {s} AND {_u('g19')} <= 0.4 THEN t || repeat('{p}', {_pick('3', 'g19n')} + 1)" for s, p in ag.PUNCT.items()]
    return "CASE " + " ".join(parts) + " ELSE t END"


for _kind, _fn, _name in [("g10", ag.add_emojis, "g10_add_emojis"), ("g16", ag.add_expression, "g16_add_expression"),
                          ("g19", ag.add_punctuation, "g19_add_punctuation")]:
    def _mk(fn):
        def q(spark, sf_dir):
            d = ds.labelled_documents(spark, sf_dir).filter(F.col("text").isNotNull())
            return d.select("doc_id", F.md5(fn(F.col("text"), F.col("label"), F.col("doc_id"))).alias("aug_md5"))
        return q
    register(_name, f"WITH d AS ({LABELLED_DOCS}) SELECT doc_id, md5({_deco_sql(_kind)}) AS aug_md5 FROM (SELECT *, text AS t FROM d WHERE text IS NOT NULL)")(_mk(_fn))


TOPIC_W = {"product": 0.6, "service": 0.4}
SENT_R = {2: 0.5, 1: 0.25, 0: 0.25}


def _g20_sql(key, topic, sent):
    cases = []
    topics = list(dict.fromkeys(t for t, _ in ag.TOPIC_TEMPLATES))
    teff = f"CASE WHEN {topic} IN ({', '.join(repr(t) for t in topics)}) THEN {topic} ELSE '{topics[0]}' END"
    for (t, s), ts in ag.TOPIC_TEMPLATES.items():
        cases.append(f"WHEN {teff} = '{t}' AND {sent} = {s} THEN {lx.sql_str_list(ts)}[{hz.sql_pick_index(str(len(ts)), key, 42, 'g20t')} + 1]")
    out = "CASE " + " ".join(cases) + " END"
    for name, fills in ag.FILLERS.items():
        out = f"replace({out}, '{{{name}}}', {lx.sql_str_list(fills)}[{hz.sql_pick_index(str(len(fills)), key, 42, 'g20' + name)} + 1])"
    return f"regexp_replace({out}, '\\{{[A-Za-z0-9_]+\\}}', '', 'g')"


@register("g20_g22_topic_comments", f"""WITH d AS ({LABELLED_DOCS}),
t AS (SELECT doc_id, label, CASE WHEN doc_id % 3 = 0 THEN 'product' WHEN doc_id % 3 = 1 THEN 'service' ELSE 'other' END AS topic FROM d),
g AS (SELECT doc_id, label, topic, unnest(range(1, 3)) AS k FROM t)
SELECT doc_id, k, {_g20_sql("concat_ws('/', CAST(doc_id AS VARCHAR), CAST(k AS VARCHAR))", 'topic', 'label')} AS comment FROM g""")
def g20_g22_topic_comments(spark, sf_dir):
    """Two generated comments per labelled document, topic from the id,
    sentiment from its label."""
    d = ds.labelled_documents(spark, sf_dir).select("doc_id", "label")
    topic = F.when(F.col("doc_id") % 3 == 0, "product").when(F.col("doc_id") % 3 == 1, "service").otherwise("other")
    g = d.select("doc_id", "label", topic.alias("topic"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k"))
    return g.select("doc_id", F.col("k").cast("long"), ag.fill_template(F.col("topic"), F.col("label"), F.concat_ws("/", F.col("doc_id").cast("string"), F.col("k").cast("string"))).alias("comment"))


@register("g23_training_data_generator", f"""WITH n AS (SELECT count(*) AS N FROM labels),
q AS (SELECT t.topic, s.sentiment, CAST(floor(floor(n.N * t.w) * s.r) AS BIGINT) AS cnt FROM n,
  (VALUES {', '.join(f"('{t}', {w})" for t, w in TOPIC_W.items())}) t(topic, w), (VALUES {', '.join(f'({s}, {r})' for s, r in SENT_R.items())}) s(sentiment, r)),
g AS (SELECT topic, sentiment, unnest(range(1, cnt + 1)) AS i FROM q),
c AS (SELECT *, {_g20_sql("concat_ws('/', topic, CAST(sentiment AS VARCHAR), CAST(i AS VARCHAR))", 'topic', 'sentiment')} AS comment FROM g)
SELECT comment, CAST(min(sentiment) AS INTEGER) AS label FROM c GROUP BY comment""")
def g23_training_data_generator(spark, sf_dir):
    """Quota table (N = labelled rows) -> rows per (topic, sentiment) ->
    template fill -> de-dup by comment (smallest label) -> seeded shuffle."""
    n = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("N"))
    q = ag.quota_table(n, TOPIC_W, SENT_R)
    g = ag.quota_rows(q)
    key = F.concat_ws("/", "topic", F.col("sentiment").cast("string"), F.col("i").cast("string"))
    c = g.select(ag.fill_template(F.col("topic"), F.col("sentiment"), key).alias("comment"),
                 F.col("sentiment").alias("label"))
    d = c.groupBy("comment").agg(F.min("label").cast("int").alias("label"))
    return sm.seeded_shuffle(d, "comment").select("comment", "label")
