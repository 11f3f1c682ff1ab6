"""Queries for text variation and synthesis over labelled documents. The
oracles draw the same numbers and edit the texts with DuckDB's own functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import augment as ag
from ..operators import dataset as ds
from ..operators import synthesize as sy
from .registry import register
from .sqlparts import LABELLED_DOCS


def _u(salt, k="0", key="key"):
    return hz.sql_u01(key, 42, salt, str(k))


def _idx(n, salt, k="0", key="key"):
    return f"CAST(floor({_u(salt, k, key)} * ({n})) AS INTEGER)"


def _pick(options, salt, k="0", key="key"):
    return f"{lx.sql_str_list(options)}[{_idx(len(options), salt, k, key)} + 1]"


def _by_label(options, salt, k="0"):
    return "CASE label " + " ".join(f"WHEN {v} THEN {_pick(xs, salt, k)}" for v, xs in options.items()) + " END"


ROWS = f"SELECT doc_id, doc_id AS key, label, text AS t FROM ({LABELLED_DOCS}) WHERE text IS NOT NULL"
WORDS = f"SELECT doc_id, key, label, t, {tx.sql_split_ws('t')} AS w FROM ({ROWS})"
SHARE = "greatest(1, len(w) // 10)"
RANKED = "list_sort(list_transform(w, lambda x, i: {{'u': {u}, 'i': i - 1}}))"


def _docs(spark, sf_dir):
    return ds.labelled_documents(spark, sf_dir).where("text is not null").select("doc_id", F.col("doc_id").alias("key"), "label", F.col("text").alias("t"))


def _words(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("w", tx.split_ws(F.col("t")))


def _md5(df, col, words=False):
    return df.select("doc_id", F.md5(F.array_join(col, " ") if words else F.col(col)).alias("aug_md5"))


def _g12_sql():
    at = f"(CAST(floor({_u('g12p', 'i - 1')} * (length(x) - 2)) AS INTEGER) + 2)"
    letters = f"replace('{sy.LETTERS}', substr(x, {at}, 1), '')"
    new = f"substr({letters}, CAST(floor({_u('g12c', 'i - 1')} * length({letters})) AS INTEGER) + 1, 1)"
    return f"""WITH r AS (SELECT *, {RANKED.format(u=_u('g12', 'i - 1'))} AS r FROM ({WORDS})),
l AS (SELECT *, r[{SHARE}].u AS last FROM r)
SELECT doc_id, md5(array_to_string(CASE WHEN len(w) < 2 THEN w ELSE list_transform(w, lambda x, i: CASE WHEN {_u('g12', 'i - 1')} <= last AND length(x) > 3
  THEN substr(x, 1, {at} - 1) || {new} || substr(x, {at} + 1) ELSE x END) END, ' ')) AS aug_md5 FROM l"""


@register("g12_character_substitution", _g12_sql())
def g12_character_substitution(spark, sf_dir):
    return _md5(sy.character_substitution(_words(spark, sf_dir), "w", "key", "o"), "o", True)


@register("g13_swap_tenth", f"""WITH r AS (SELECT *, {RANKED.format(u=_u('g13', 'i - 1'))} AS r, 2 * {SHARE} AS m FROM ({WORDS})),
p AS (SELECT *, list_sort(list_transform(r, lambda x, j: {{'to': x.i, 'of': CASE WHEN j - 1 < m THEN r[xor(j - 1, 1) + 1].i ELSE x.i END}})) AS p FROM r)
SELECT doc_id, md5(array_to_string(CASE WHEN len(w) < 2 THEN w ELSE list_transform(p, lambda x: w[x.of + 1]) END, ' ')) AS aug_md5 FROM p""")
def g13_swap_tenth(spark, sf_dir):
    return _md5(sy.swap_tenth(_words(spark, sf_dir), "w", "key", "o"), "o", True)


@register("g15_self_insertion", f"""WITH x AS (SELECT *, list_sort(list_concat(
  list_transform(w, lambda x, i: {{'at': i - 1, 'own': 1, 'n': 0::BIGINT, 'w': x}}),
  list_transform(range(0, {SHARE}), lambda j: {{'at': CAST(floor({_u('g15g', 'j')} * (len(w) + 1)) AS BIGINT), 'own': 0, 'n': j,
    'w': w[CAST(floor({_u('g15s', 'j')} * len(w)) AS INTEGER) + 1]}}))) AS x FROM ({WORDS}) WHERE len(w) > 0)
SELECT doc_id, md5(array_to_string(list_transform(x, lambda e: e.w), ' ')) AS aug_md5 FROM x
UNION ALL SELECT doc_id, md5('') FROM ({WORDS}) WHERE len(w) = 0""")
def g15_self_insertion(spark, sf_dir):
    return _md5(sy.self_insertion(_words(spark, sf_dir), "w", "key", "o"), "o", True)


# ---- SQL of the composed texts: each takes a relation with key, label and a text
# column t (and whatever else) and gives it with another t

def _emoji(t, key="key"):
    parts = []
    for s, es in ag.EMOJIS.items():
        e = _pick(es, "g10e", key=key)
        parts.append(f"WHEN label = {s} AND {_u('g10', key=key)} <= 0.3 THEN CASE WHEN {_u('g10side', key=key)} < 0.5 THEN {e} || ' ' || {t} ELSE {t} || ' ' || {e} END")
    return f"CASE {' '.join(parts)} ELSE {t} END"


def _humanized(rel):
    k = "i - 1"
    variant = f"coalesce(CASE lower(x) {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b[0]}{chr(39)}' for a, b in ag.VARIANTS.items())} END, x)"
    pos = f"(CAST(floor({_u('g8p', k)} * (length(x) - 1)) AS INTEGER) + 1)"
    cands = f"CASE lower(substring(x, {pos} + 1, 1)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ag.KEY_NEIGHBOURS.items()) + " END"
    ch = f"substring({cands}, CAST(floor({_u('g8c', k)} * length({cands})) AS INTEGER) + 1, 1)"
    typo = f"CASE WHEN length(x) >= 4 AND {_u('g8', k)} <= 0.3 AND ({cands}) IS NOT NULL THEN substring(x, 1, {pos}) || {ch} || substring(x, {pos} + 2) ELSE x END"
    long = f"CASE WHEN {_u('g11r', k)} < 0.1 AND contains('{sy.REPEATABLE}', right(x, 1)) THEN x || repeat(right(x, 1), CAST(floor({_u('g11n', k)} * 3) AS INTEGER) + 1) ELSE x END"
    words = f"list_transform({tx.sql_split_ws('t')}, lambda x, i: CASE WHEN {_u('g11v', k)} < 0.3 THEN {variant} WHEN {_u('g11t', k)} < 0.2 THEN {typo} ELSE x END)"
    a = f"SELECT * REPLACE (array_to_string(list_transform({words}, lambda x, i: {long}), ' ') AS t) FROM ({rel})"
    b = f"SELECT * REPLACE ({_emoji('t')} AS t) FROM ({a})"
    return f"SELECT * REPLACE (CASE WHEN {_u('g11e')} < 0.2 THEN t || {_pick(sy.ENDINGS, 'g11x')} ELSE t END AS t) FROM ({b})"


def _term(x, salt, k):
    return f"CASE lower({x}) " + " ".join(f"WHEN '{w}' THEN {_pick(f, salt, k)}" for w, f in sy.TERMS.items()) + f" ELSE {x} END"


def _slanged(rel):
    return f"""SELECT * REPLACE (CASE WHEN {_u('g17')} <= 0.4 THEN array_to_string(list_transform({tx.sql_split_ws('t')},
  lambda x, i: CASE WHEN {_u('g17w', 'i - 1')} < 0.3 THEN {_term('x', 'g17p', 'i - 1')} ELSE x END), ' ') ELSE t END AS t) FROM ({rel})"""


def _combined(rel):
    def one(j):
        return f"""CASE {_idx(3, 'g18k', j)} WHEN 0 THEN {_by_label(sy.SLANG, 'g18s', j)} WHEN 1 THEN {_by_label(ag.EXPRESSIONS, 'g18x', j)}
          ELSE {_term(_pick(list(sy.TERMS), 'g18w', j), 'g18t', j)} END"""
    e = f"SELECT *, [{one(0)}, {one(1)}, {one(2)}][1:{_idx(3, 'g18n')} + 1] AS e FROM ({rel})"
    return f"""SELECT * EXCLUDE (e) REPLACE (CASE WHEN {_u('g18')} > 0.3 THEN t ELSE CASE {_idx(3, 'g18p')} WHEN 0 THEN array_to_string(e, ' ') || ' ' || t
      WHEN 1 THEN t || ' ' || array_to_string(e, ' ') ELSE e[1] || ' ' || t || ' ' || array_to_string(e[2:], ' ') END END AS t) FROM ({e})"""


def _template(topic):
    topics = list(dict.fromkeys(t for t, _ in ag.TOPIC_TEMPLATES))
    known = f"CASE WHEN {topic} IN ({', '.join(map(repr, topics))}) THEN {topic} ELSE '{topics[0]}' END"
    out = "CASE " + " ".join(f"WHEN {known} = '{t}' AND label = {s} THEN {_pick(ts, 'g20t')}" for (t, s), ts in ag.TOPIC_TEMPLATES.items()) + " END"
    for name, fills in ag.FILLERS.items():
        out = f"replace({out}, '{{{name}}}', {_pick(fills, 'g20' + name)})"
    return f"regexp_replace({out}, '\\{{[A-Za-z0-9_]+\\}}', '', 'g')"


def _varied():
    duration = f"replace({_pick(sy.DURATIONS, 'g26d')}, '{{number}}', {_pick(sy.NUMBERS, 'g26dn')})"
    long = _by_label(sy.LONG, "g26l")
    for name, v in (("duration", duration), ("count", _pick(sy.NUMBERS, "g26n")), ("action", _pick(sy.ACTIONS, "g26a")), ("emotion", _by_label(sy.EMOTIONS, "g26e"))):
        long = f"replace({long}, '{{{name}}}', {v})"
    short = f"replace({_by_label(sy.SHORT, 'g26s')}, '{{score}}', {_by_label(sy.SCORES, 'g26c')})"
    general = "'general'"
    return f"CASE WHEN {_u('g26')} < 0.3 THEN {short} WHEN {_u('g26b')} < 0.7 THEN {_template(general)} ELSE {long} END"


def _interaction(kind):
    out = _pick(sy.INTERACTIONS[kind], "g27")
    for name, values in sy.INTERACTION_FILLERS.items():
        out = f"replace({out}, '{{{name}}}', {_pick(values, 'g27' + name)})"
    return out


def _interaction_for():
    return "CASE " + " ".join(f"WHEN label = {v} AND {_idx(len(kinds), 'g27k')} = {j} THEN {_interaction(kind)}" for v, kinds in sy.INTERACTION_OF.items() for j, kind in enumerate(kinds)) + " END"


def _natural(rel):
    a = f"SELECT * REPLACE (CASE WHEN {_u('g24o')} < 0.7 THEN {_pick(sy.OPENINGS, 'g24op')} || ', ' || t ELSE t END AS t) FROM ({rel})"
    b = f"SELECT * REPLACE (CASE WHEN {_u('g24c')} < 0.5 THEN t || '. ' || {_pick(sy.CLOSINGS, 'g24cp')} ELSE t END AS t) FROM ({a})"
    mood = "CASE label " + " ".join(
        f"WHEN {v} THEN array_to_string(list_transform(list_sort([{', '.join('{' + chr(39) + 'u' + chr(39) + ': ' + _u('g24e', j) + ', ' + chr(39) + 'x' + chr(39) + ': ' + chr(39) + x + chr(39) + '}' for j, x in enumerate(xs))}])[1:{_idx(3, 'g24n')} + 1], lambda e: e.x), '')"
        for v, xs in sy.MOOD_EMOJIS.items()) + " END"
    return f"SELECT * REPLACE (CASE WHEN {_u('g24')} < 0.8 THEN t || ' ' || {mood} ELSE t END AS t) FROM ({b})"


def _out(rel):
    return f"SELECT doc_id, md5(t) AS aug_md5 FROM ({rel})"


@register("g11_humanize", _out(_humanized(ROWS)))
def g11_humanize(spark, sf_dir):
    return _md5(sy.humanize(_docs(spark, sf_dir), "t", "key", "label", "o"), "o")


@register("g17_internet_slang", _out(_slanged(ROWS)))
def g17_internet_slang(spark, sf_dir):
    return _md5(sy.internet_slang(_docs(spark, sf_dir), "t", "key", "o"), "o")


@register("g18_combine_expressions", _out(_combined(ROWS)))
def g18_combine_expressions(spark, sf_dir):
    return _md5(sy.combine_expressions(_docs(spark, sf_dir), "t", "key", "label", "o"), "o")


@register("g24_natural_variation", _out(_natural(ROWS)))
def g24_natural_variation(spark, sf_dir):
    return _md5(sy.natural_variation(_docs(spark, sf_dir), "t", "key", "label", "o"), "o")


@register("g26_varied_length", f"SELECT doc_id, {_varied()} AS comment FROM ({ROWS})")
def g26_varied_length(spark, sf_dir):
    return sy.varied_length(_docs(spark, sf_dir), "key", "label", F.lit("general"), "comment").select("doc_id", "comment")


@register("g27_interaction_comment", f"SELECT doc_id, {_interaction_for()} AS comment FROM ({ROWS})")
def g27_interaction_comment(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", sy.interaction_for(F.col("label"), F.col("key")).alias("comment"))


@register("g28_pickers", f"""SELECT doc_id, {_by_label(sy.SLANG, 'p1')} AS slang, {_pick(sy.INTENSIFIERS['en'], 'p2')} AS intensifier,
  {_term(_pick(list(sy.TERMS), 'p3'), 'p4', '0')} AS term, replace({_pick(sy.DURATIONS, 'g28d')}, '{{number}}', {_pick(sy.NUMBERS, 'g28dn')}) AS duration,
  {_by_label(sy.SCORES, 'p5')} AS score FROM ({ROWS})""")
def g28_pickers(spark, sf_dir):
    k, lab = F.col("key"), F.col("label")
    return _docs(spark, sf_dir).select("doc_id", sy.by_label(sy.SLANG, lab, k, "p1").alias("slang"), sy.pick(sy.INTENSIFIERS["en"], k, "p2").alias("intensifier"),
                                       sy.internet_term(sy.pick(list(sy.TERMS), k, "p3"), k, "p4").alias("term"), sy.duration(k).alias("duration"),
                                       sy.by_label(sy.SCORES, lab, k, "p5").alias("score"))


def _g25_sql():
    rel = f"SELECT doc_id, label, t, CAST(x AS INTEGER) AS try, concat_ws('/', CAST(doc_id AS VARCHAR), CAST(x AS VARCHAR)) AS key FROM ({ROWS}), (VALUES (1), (2), (3), (4)) v(x)"
    s = f"SELECT * REPLACE (CASE WHEN {_u('g25i')} < 0.2 THEN {_interaction_for()} WHEN {_u('g25l')} < 0.3 THEN {_varied()} ELSE t END AS t) FROM ({_humanized(rel)})"
    return f"""SELECT doc_id, label, min(try) AS try, md5(t) AS variant_md5 FROM ({_natural(s)}) WHERE len({tx.sql_split_ws('t')}) >= 3 GROUP BY doc_id, label, t"""


@register("g25_synthetic_variants", _g25_sql())
def g25_synthetic_variants(spark, sf_dir):
    got = sy.synthetic_variants(_docs(spark, sf_dir).select("doc_id", "label", "t"), "t", "doc_id", "label")
    return got.select("doc_id", "label", "try", F.md5("variant").alias("variant_md5"))


def _g21_sql():
    rel = f"SELECT doc_id, doc_id AS key, label, topic, {_template('topic')} AS t FROM (SELECT doc_id, doc_id AS key, label, CASE doc_id % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'service' ELSE 'other' END AS topic FROM ({ROWS}))"
    h = _humanized(rel)
    # the slang form is a column beside the text
    s = f"SELECT a.*, b.t AS s FROM ({h}) a JOIN ({_slanged(h)}) b USING (doc_id)"
    s = f"SELECT * EXCLUDE (s) REPLACE (CASE WHEN {_u('g21s')} < 0.4 THEN CASE WHEN {_u('g21i')} < 0.3 THEN {_pick(sy.INTENSIFIERS['en'], 'g21ip')} || ' ' || s ELSE s END ELSE t END AS t) FROM ({s})"
    parts = []
    for v, xs in ag.EXPRESSIONS.items():
        x = _pick(xs, "g16x")
        parts.append(f"WHEN label = {v} AND {_u('g16')} <= 0.3 THEN CASE WHEN {_u('g16side')} < 0.5 THEN {x} || ', ' || lower(t) ELSE t || '. ' || {x} END")
    s = f"SELECT * REPLACE (CASE {' '.join(parts)} ELSE t END AS t) FROM ({s})"
    again = "concat_ws('/', CAST(key AS VARCHAR), 'again')"
    s = f"SELECT * REPLACE ({_emoji('t', again)} AS t) FROM ({s})"
    s = f"SELECT * REPLACE (CASE WHEN {_u('g21e')} < 0.3 THEN t || {_pick(sy.ENDINGS, 'g21ep')} ELSE t END AS t) FROM ({s})"
    context = " ".join(f"WHEN topic = '{t}' AND {_u('g21c')} < 0.3 THEN {_pick(xs, 'g21cp')} || ', ' || t" for t, xs in sy.CONTEXTS.items())
    s = _combined(f"SELECT * REPLACE (CASE {context} ELSE t END AS t) FROM ({s})")
    marks = " ".join(f"WHEN label = {v} AND {_u('g19')} <= 0.4 THEN t || repeat('{p}', {_idx(3, 'g19n')} + 1)" for v, p in ag.PUNCT.items())
    return f"SELECT doc_id, CASE {marks} ELSE t END AS comment FROM ({s})"


@register("g21_realistic_comment", _g21_sql())
def g21_realistic_comment(spark, sf_dir):
    topic = F.when(F.col("doc_id") % 3 == 0, "product").when(F.col("doc_id") % 3 == 1, "service").otherwise("other")
    d = _docs(spark, sf_dir).select("doc_id", "key", "label", topic.alias("topic"))
    return sy.realistic_comment(d, "key", "label", "topic", "comment").select("doc_id", "comment")
