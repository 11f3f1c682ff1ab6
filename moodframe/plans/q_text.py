"""Queries for validation/preprocessing (P*) and text operators (X*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import dataset as ds
from ..operators import emotion as em
from ..sources.tables import table
from .registry import register
from .sqlparts import LABELLED_DOCS

# Label strings assigned to labelled documents, covering numbers, floats,
# names, blanks and nulls.
LABEL_STRINGS = ["0", "1", "2", "3", "-1", "1.7", "2.0", "positive", "NEGATIVE", "", None, " 2 ", "abc", "neutral"]


def _label_str_col(key):
    arr = F.array(*[F.lit(x).cast("string") for x in LABEL_STRINGS])
    return F.element_at(arr, hz.pick_index(len(LABEL_STRINGS), key, 42, "labelstr") + 1)


def _label_str_sql(key):
    lst = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in LABEL_STRINGS) + "]"
    return f"{lst}[{hz.sql_pick_index(str(len(LABEL_STRINGS)), key, 42, 'labelstr')} + 1]"


def _raw_labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id").withColumn("label", _label_str_col(F.col("doc_id")))


RAW_LABELLED_SQL = f"""SELECT d.doc_id, d.text, {_label_str_sql('d.doc_id')} AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def _sql_coerce(e, names):
    s = tx.sql_py_strip(e)
    num = f"TRY_CAST({s} AS DOUBLE)"
    as_int = f"(CASE WHEN {num} IS NOT NULL AND NOT isnan({num}) AND abs({num}) < 2147483648.0 THEN CAST(trunc({num}) AS INTEGER) END)"
    if names:
        named = f"(CASE lower({s}) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END)"
        as_int = f"coalesce({named}, {as_int})"
    return f"(CASE WHEN {as_int} IN (0, 1, 2) THEN {as_int} END)"


@register("p1_validate_dataset", f"""
WITH r AS ({RAW_LABELLED_SQL})
SELECT doc_id, md5({tx.sql_py_strip('text')}) AS text_md5, {_sql_coerce('label', False)} AS label
FROM r WHERE {_sql_coerce('label', False)} IS NOT NULL
""")
def p1_validate(spark, sf_dir):
    v = ds.validate(_raw_labelled(spark, sf_dir))
    return v.select("doc_id", F.md5("text").alias("text_md5"), "label")


@register("p2_preprocess", f"""
WITH r AS ({RAW_LABELLED_SQL}),
c AS (SELECT doc_id, {tx.sql_clean_text('text')} AS cleaned_text, label FROM r WHERE text IS NOT NULL)
SELECT doc_id, cleaned_text, {_sql_coerce('label', True)} AS label FROM c
WHERE length(cleaned_text) > 3 AND {_sql_coerce('label', True)} IS NOT NULL
""")
def p2_preprocess(spark, sf_dir):
    return ds.preprocess(_raw_labelled(spark, sf_dir), "en").select("doc_id", "cleaned_text", "label")


@register("p3_min_clean_length", f"""
SELECT doc_id, text IS NOT NULL AND length({tx.sql_clean_text('text')}) > 3 AS keep FROM documents
""")
def p3_min_clean_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    keep = F.coalesce(F.length(tx.clean_text(F.col("text"))) > 3, F.lit(False))
    return d.select("doc_id", keep.alias("keep"))


@register("p4_min_raw_length", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 2000")
def p4_min_raw_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") >= 2000).select("doc_id", "n_chars")


@register("p5_features_and_labels", f"""
WITH d AS ({LABELLED_DOCS})
SELECT doc_id, {tx.sql_clean_text('text')} AS cleaned_text, label FROM d
WHERE label IN (0, 1, 2) AND text IS NOT NULL
""")
def p5_features_and_labels(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir).filter(F.col("text").isNotNull())
    c = d.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned_text"), "label")
    ds.features_and_labels(c)  # raises when no row has a valid label
    return c.filter(F.col("label").isin(ds.LABELS))


@register("p6_default_neutral", f"""
SELECT CAST(1 AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n FROM documents
WHERE text IS NOT NULL AND length({tx.sql_clean_text('text')}) > 3
""")
def p6_default_neutral(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ds.preprocess(d, "en").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("p7_fine_to_sentiment", f"""
SELECT doc_id, CAST(CASE WHEN s IN (2,3,4,5,6) THEN 2 WHEN s IN (0,7,8,9,10) THEN 0 ELSE 1 END AS INTEGER) AS label
FROM (SELECT doc_id, {hz.sql_pick_index('16', 'doc_id', 42, 'sent')} AS s FROM labels)
""")
def p7_fine_to_sentiment(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", hz.pick_index(16, F.col("doc_id"), 42, "sent").alias("sentiment"))
    return lab.select("doc_id", ds.fine_to_sentiment("sentiment").alias("label"))


_P8_NAMES = list(lx.EMOTION_TO_SENTIMENT) + ["unknown"]


@register("p8_emotion_name_to_sentiment", f"""
WITH n AS (SELECT doc_id, {lx.sql_str_list(_P8_NAMES)}[{hz.sql_pick_index(str(len(_P8_NAMES)), 'doc_id', 42, 'emo')} + 1] AS emotion FROM labels)
SELECT doc_id, emotion, CAST(CASE emotion {' '.join(f"WHEN '{k}' THEN {v}" for k, v in lx.EMOTION_TO_SENTIMENT.items())} END AS INTEGER) AS sentiment FROM n
""")
def p8_emotion_name_to_sentiment(spark, sf_dir):
    arr = F.array(*[F.lit(x) for x in _P8_NAMES])
    n = table(spark, sf_dir, "labels").select(
        "doc_id", F.element_at(arr, hz.pick_index(len(_P8_NAMES), F.col("doc_id"), 42, "emo") + 1).alias("emotion"))
    return n.select("doc_id", "emotion", ds.emotion_name_to_sentiment("emotion").alias("sentiment"))


@register("p9_rating_to_sentiment", """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(1 + doc_id % 5 AS INTEGER) END AS score FROM documents)
SELECT doc_id, score, CAST(CASE WHEN score > 3 THEN 2 WHEN score < 3 THEN 0 ELSE 1 END AS INTEGER) AS sentiment FROM r
""")
def p9_rating_to_sentiment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(1 + F.col("doc_id") % 5).cast("int").alias("score"))
    return d.select("doc_id", "score", ds.rating_to_sentiment("score").alias("sentiment"))


@register("p10_sentiment_names", f"""
WITH s AS (SELECT doc_id, CAST({hz.sql_pick_index('4', 'doc_id', 42, 'code')} AS INTEGER) AS code FROM labels)
SELECT doc_id, code,
  CASE code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in lx.SENTIMENT_NAMES.items())} ELSE 'Unknown' END AS name_en,
  CASE code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in lx.SENTIMENT_NAMES_VI.items())} ELSE 'Unknown' END AS name_vi
FROM s
""")
def p10_sentiment_names(spark, sf_dir):
    s = table(spark, sf_dir, "labels").select("doc_id", hz.pick_index(4, F.col("doc_id"), 42, "code").alias("code"))
    return s.select("doc_id", "code", ds.sentiment_name("code", "en").alias("name_en"),
                    ds.sentiment_name("code", "vi").alias("name_vi"))


@register("p11_drop_missing", """
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND d.lang IS NOT NULL AND d.source IS NOT NULL AND d.n_chars IS NOT NULL
  AND l.quality IS NOT NULL AND l.toxic IS NOT NULL
""")
def p11_drop_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.dropna("any").select("doc_id", "quality", "toxic")


@register("p12_needs_labelling", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL
""")
def p12_needs_labelling(spark, sf_dir):
    d = ds.labelled_documents(spark, sf_dir, how="left")
    return d.filter(F.col("label").isNull()).select("doc_id")


@register("p15_language_filter", """
SELECT doc_id, lang, lang IN ('vi', 'en') AS accepted FROM documents
""")
def p15_language_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.coalesce(F.col("lang").isin("vi", "en"), F.lit(False)).alias("accepted"))


def _post_urls(key, url):
    k = hz.pick_index(5, key, 42, "url")
    return (F.when(k == 0, F.concat(F.lit("https://www.facebook.com/page"), key.cast("string"), F.lit("/posts/"), (key * 7).cast("string")))
             .when(k == 1, F.concat(F.lit("https://facebook.com/group/permalink/"), key.cast("string"), F.lit("/")))
             .when(k == 2, F.concat(F.lit("https://m.facebook.com/photo.php?fbid="), key.cast("string")))
             .otherwise(url))


def _post_urls_sql(key, url):
    k = hz.sql_pick_index("5", key, 42, "url")
    return (f"CASE WHEN {k} = 0 THEN 'https://www.facebook.com/page' || {key} || '/posts/' || ({key} * 7) "
            f"WHEN {k} = 1 THEN 'https://facebook.com/group/permalink/' || {key} || '/' "
            f"WHEN {k} = 2 THEN 'https://m.facebook.com/photo.php?fbid=' || {key} ELSE {url} END")


@register("p16_post_url_and_id", f"""
WITH u AS (SELECT page_id, {_post_urls_sql('page_id', 'url')} AS url FROM pages)
SELECT page_id, {tx.sql_is_post_url('url')} AS is_post, {tx.sql_post_id('url')} AS post_id FROM u
""")
def p16_post_url_and_id(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", _post_urls(F.col("page_id"), F.col("url")).alias("url"))
    return p.select("page_id", tx.is_post_url("url").alias("is_post"), tx.post_id("url").alias("post_id"))


@register("p17_batch_result_projection", f"""
WITH d AS ({LABELLED_DOCS})
SELECT doc_id, label AS r_label,
  CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END AS r_sentiment,
  CASE label WHEN 0 THEN 'sad' WHEN 1 THEN 'neutral' ELSE 'happy' END AS r_emotion,
  length(text) AS r_text_len
FROM d
""")
def p17_batch_result_projection(spark, sf_dir):
    """Nested per-row result struct, projected back to flat columns."""
    d = ds.labelled_documents(spark, sf_dir)
    res = F.struct(F.col("text"), F.col("label"), ds.sentiment_name("label").alias("sentiment"),
                   F.struct(em.pick_emotion(F.lit(None), F.col("label")).alias("name")).alias("emotion"))
    r = d.select("doc_id", res.alias("r"))
    return r.select("doc_id", F.col("r.label").alias("r_label"), F.col("r.sentiment").alias("r_sentiment"),
                    F.col("r.emotion.name").alias("r_emotion"), F.length("r.text").alias("r_text_len"))


# ---- X1-X16 -------------------------------------------------------------------

@register("x1_strip_tags", f"""
SELECT page_id, md5({tx.sql_strip_tags('html')}) AS stripped_md5, length({tx.sql_strip_tags('html')}) AS stripped_len FROM pages
""")
def x1_strip_tags(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", tx.strip_tags("html").alias("s"))
    return p.select("page_id", F.md5("s").alias("stripped_md5"), F.length("s").alias("stripped_len"))


_DECOMP = {"é": "é", "è": "è", "ê": "ê", "à": "à", "ç": "ç"}


def _decompose(c):
    for a, b in _DECOMP.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _decompose_sql(e):
    for a, b in _DECOMP.items():
        e = f"replace({e}, '{a}', '{b}')"
    return e


@register("x2_nfc_normalize", f"""
SELECT doc_id, md5(nfc_normalize({_decompose_sql('text')})) AS nfc_md5,
       nfc_normalize({_decompose_sql('text')}) = text AS same_as_source,
       length({_decompose_sql('text')}) - length(text) AS marks_added
FROM documents
""")
def x2_nfc_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    dd = d.select("doc_id", "text", _decompose(F.col("text")).alias("nfd"))
    n = dd.select("doc_id", "text", "nfd", tx.nfc(F.col("nfd")).alias("nfc"))
    return n.select("doc_id", F.md5("nfc").alias("nfc_md5"), (F.col("nfc") == F.col("text")).alias("same_as_source"),
                    (F.length("nfd") - F.length("text")).alias("marks_added"))


@register("x3_x5_normalize_chars", f"""
SELECT doc_id, md5(lower(regexp_replace(regexp_replace({tx.sql_strip_tags('text')}, '{tx.NON_WORD}', ' ', 'g'), '{tx.DIGIT_UNDERSCORE}', ' ', 'g'))) AS norm_md5
FROM documents
""")
def x3_x5_normalize_chars(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    x = F.lower(tx.digits_to_space(tx.non_word_to_space(tx.strip_tags("text"))))
    return d.select("doc_id", F.md5(x).alias("norm_md5"))


@register("x6_tokenize", f"""
WITH t AS (SELECT doc_id, {tx.sql_split_contractions(tx.sql_split_ws("lower(regexp_replace(regexp_replace(text, '" + tx.NON_WORD + "', ' ', 'g'), '" + tx.DIGIT_UNDERSCORE + "', ' ', 'g'))"))} AS toks
           FROM ({"SELECT doc_id, text || ' cannot gonna' AS text FROM documents"}))
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, toks[1] AS first_token, toks[len(toks)] AS last_token FROM t
""")
def x6_tokenize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" cannot gonna")).alias("text"))
    toks = tx.split_contractions(tx.split_ws(F.lower(tx.digits_to_space(tx.non_word_to_space("text")))))
    t = d.select("doc_id", toks.alias("toks"))
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.get("toks", 0).alias("first_token"),
                    F.get("toks", F.size("toks") - 1).alias("last_token"))


_VI_WORDS = ["có", "thể", "và", "của", "trong", "khi", "đã", "từng", "các", "bạn", "này", "tốt", "vui"]


def _vi_suffix(key):
    arr = F.array(*[F.lit(w) for w in _VI_WORDS])
    return F.concat_ws(" ", *[F.element_at(arr, hz.pick_index(len(_VI_WORDS), key, 42, "vi", k) + 1) for k in range(8)])


def _vi_suffix_sql(key):
    arr = lx.sql_str_list(_VI_WORDS)
    return " || ' ' || ".join(f"{arr}[{hz.sql_pick_index(str(len(_VI_WORDS)), key, 42, 'vi', str(k))} + 1]" for k in range(8))


@register("x7_vi_compound_stop_words", f"""
WITH d AS (SELECT doc_id, text || ' ' || {_vi_suffix_sql('doc_id')} AS text FROM documents),
t AS (SELECT doc_id, {tx.sql_split_ws("lower(regexp_replace(regexp_replace(nfc_normalize(" + tx.sql_strip_tags('text') + "), '" + tx.NON_WORD + "', ' ', 'g'), '" + tx.DIGIT_UNDERSCORE + "', ' ', 'g'))")} AS toks FROM d)
SELECT doc_id, array_to_string({tx.sql_remove_stop_words('toks', 'vi')}, ' ') AS cleaned_text FROM t
""")
def x7_vi_compound_stop_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", _vi_suffix(F.col("doc_id"))).alias("text"))
    return d.select("doc_id", tx.clean_text(F.col("text"), "vi").alias("cleaned_text"))


@register("x8_stop_words", f"""
SELECT doc_id, {tx.sql_clean_text('text', 'en')} AS cleaned_text FROM documents
""")
def x8_stop_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_text(F.col("text"), "en").alias("cleaned_text"))


@register("x8_stop_words_compat", f"""
SELECT doc_id, {tx.sql_clean_text('text', 'en', True)} AS cleaned_text FROM documents
""")
def x8_stop_words_compat(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_text(F.col("text"), "en", compat=True).alias("cleaned_text"))


@register("x9_light_normalize", f"""
SELECT item_id, lower({tx.sql_py_strip("'  ' || text || chr(10)")}) AS norm FROM benchmark
""")
def x9_light_normalize(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", tx.light_normalize(F.concat(F.lit("  "), F.col("text"), F.lit("\n"))).alias("norm"))


@register("x10_detect_language", f"""
SELECT conv_id, turn, {tx.sql_detect_language('text')} AS language FROM conversations
""")
def x10_detect_language(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.detect_language("text").alias("language"))


def _reaction_text(key):
    a = hz.pick_index(50, key, 42, "ra")
    b = hz.pick_index(9, key, 42, "rb")
    k = hz.pick_index(5, key, 42, "rk")
    return (F.when(k == 0, F.format_string("%d likes and %d HAHA", a, b))
             .when(k == 1, F.format_string("%d thích, %d buồn, %d phẫn nộ", a, b, a + b))
             .when(k == 2, F.format_string("%d people reacted", a))
             .when(k == 3, F.format_string("%d love %d wow %d sad %d angry", a, b, b, a))
             .otherwise(F.lit("no reactions")))


def _reaction_text_sql(key):
    a = hz.sql_pick_index("50", key, 42, "ra")
    b = hz.sql_pick_index("9", key, 42, "rb")
    k = hz.sql_pick_index("5", key, 42, "rk")
    return (f"CASE WHEN {k} = 0 THEN {a} || ' likes and ' || {b} || ' HAHA' "
            f"WHEN {k} = 1 THEN {a} || ' thích, ' || {b} || ' buồn, ' || ({a} + {b}) || ' phẫn nộ' "
            f"WHEN {k} = 2 THEN {a} || ' people reacted' "
            f"WHEN {k} = 3 THEN {a} || ' love ' || {b} || ' wow ' || {b} || ' sad ' || {a} || ' angry' "
            f"ELSE 'no reactions' END")


def _x11_sql():
    key = "(conv_id * 1000 + turn)"
    parts = []
    for name, words in tx.REACTION_PATTERNS:
        v = f"regexp_extract(t, '(?i)([0-9]+)[{tx.WS}]*({words})', 1)"
        parts.append((name, f"CASE WHEN {v} <> '' THEN CAST({v} AS INTEGER) END"))
    typed = " + ".join(f"coalesce({e}, 0)" for _, e in parts)
    first = "regexp_extract(t, '([0-9]+)', 1)"
    total = f"CASE WHEN ({typed}) = 0 THEN (CASE WHEN {first} <> '' THEN CAST({first} AS INTEGER) ELSE 0 END) ELSE ({typed}) END"
    cols = ", ".join(f"{e} AS r_{n}" for n, e in parts)
    return f"WITH r AS (SELECT conv_id, turn, {_reaction_text_sql(key)} AS t FROM conversations) SELECT conv_id, turn, {total} AS total, {cols} FROM r"


@register("x11_reaction_counts", _x11_sql())
def x11_reaction_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = c.select("conv_id", "turn", tx.reaction_counts(_reaction_text(F.col("conv_id") * 1000 + F.col("turn"))).alias("r"))
    return r.select("conv_id", "turn", F.col("r.total").alias("total"),
                    *[F.element_at("r.types", n).alias(f"r_{n}") for n, _ in tx.REACTION_PATTERNS])


@register("x12_first_integer", """
SELECT page_id, CASE WHEN regexp_extract(url, '[0-9]+', 0) <> '' THEN CAST(regexp_extract(url, '[0-9]+', 0) AS BIGINT) ELSE 0 END AS n FROM pages
""")
def x12_first_integer(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.first_integer("url").alias("n"))


def _label_text(key, role):
    k = hz.pick_index(5, key, 42, "lbl")
    return (F.when(k == 0, F.concat(F.lit("Comment by "), role, F.lit("  ")))
             .when(k == 1, F.concat(F.lit("Bình luận bởi "), role))
             .when(k == 2, F.concat(F.lit("trả lời bởi "), F.upper(role)))
             .when(k == 3, F.concat(F.lit("Reply by "), role))
             .otherwise(F.concat(role, F.lit(" wrote"))))


def _label_text_sql(key, role):
    k = hz.sql_pick_index("5", key, 42, "lbl")
    return (f"CASE WHEN {k} = 0 THEN 'Comment by ' || {role} || '  ' WHEN {k} = 1 THEN 'Bình luận bởi ' || {role} "
            f"WHEN {k} = 2 THEN 'trả lời bởi ' || upper({role}) WHEN {k} = 3 THEN 'Reply by ' || {role} ELSE {role} || ' wrote' END")


@register("x13_author_from_label", f"""
WITH l AS (SELECT conv_id, turn, {_label_text_sql('(conv_id * 1000 + turn)', 'role')} AS lbl FROM conversations)
SELECT conv_id, turn, nullif({tx.sql_py_strip("CASE WHEN regexp_matches(lbl, '" + tx.AUTHOR_VI + "') THEN regexp_extract(lbl, '" + tx.AUTHOR_VI + "', 1) WHEN regexp_matches(lbl, '" + tx.AUTHOR_EN + "') THEN regexp_extract(lbl, '" + tx.AUTHOR_EN + "', 1) END")}, '') AS author
FROM l
""")
def x13_author_from_label(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    l = c.select("conv_id", "turn", _label_text(F.col("conv_id") * 1000 + F.col("turn"), F.col("role")).alias("lbl"))
    return l.select("conv_id", "turn", tx.author_from_label("lbl").alias("author"))


_REL = ["5h", "12m", "3d", "10x", "1y", "40s", "2w", "7H"]


@register("x14_relative_time", f"""
WITH r AS (SELECT conv_id, turn, {lx.sql_str_list(_REL)}[{hz.sql_pick_index(str(len(_REL)), '(conv_id * 1000 + turn)', 42, 'rel')} + 1] AS rel FROM conversations)
SELECT conv_id, turn, rel, regexp_matches(rel, '{tx.RELATIVE_TIME}') AS is_time,
  CASE WHEN regexp_matches(rel, '{tx.RELATIVE_TIME}') THEN CAST(regexp_extract(lower(rel), '^([0-9]+)', 1) AS BIGINT) *
    CASE right(lower(rel), 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'y' THEN 31536000 END END AS seconds
FROM r
""")
def x14_relative_time(spark, sf_dir):
    arr = F.array(*[F.lit(x) for x in _REL])
    c = table(spark, sf_dir, "conversations")
    r = c.select("conv_id", "turn", F.element_at(arr, hz.pick_index(len(_REL), F.col("conv_id") * 1000 + F.col("turn"), 42, "rel") + 1).alias("rel"))
    return r.select("conv_id", "turn", "rel", tx.is_relative_time("rel").alias("is_time"),
                    tx.relative_time_seconds("rel").alias("seconds"))


# Turns rendered as comment markup; every kind of reply mark, near misses and none.
REPLY_MARKUP = ['<a href="/x?reply_comment_id=7">', '<div aria-label="Reply by A">', '<div aria-label="Trả lời của B">',
                '<div style="x: 1; margin-left: 4px">', '<div style="padding-left:2px">', '<div aria-label="Comment" title="Reply">',
                '<div style="margin-right: 4px">', "<div>"]


@register("x15_reply_flag", f"""
SELECT conv_id, turn, (conv_id * 3 + turn) % 8 < 5 AS is_reply FROM conversations
""")
def x15_reply_flag(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = ((F.col("conv_id") * 3 + F.col("turn")) % len(REPLY_MARKUP)).cast("int")
    html = F.concat(F.element_at(F.array(*map(F.lit, REPLY_MARKUP)), n + 1), F.regexp_replace("text", "<", "&lt;"))
    return c.select("conv_id", "turn", tx.is_reply_markup(html).alias("is_reply"))


@register("x15_reply_flag_markup", """
SELECT page_id, coalesce(regexp_matches(html, 'reply_comment_id|aria-label="[^"]*(Reply|Trả lời)|style="[^"]*(margin-left|padding-left)'), false) AS is_reply FROM pages
""")
def x15_reply_flag_markup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.is_reply_markup("html").alias("is_reply"))


@register("x16_comment_key", """
SELECT conv_id, turn, md5(concat_ws('-', role, text, CAST(turn AS VARCHAR) || 'h')) AS comment_key FROM conversations
""")
def x16_comment_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = tx.comment_key(F.col("role"), F.col("text"), F.concat(F.col("turn").cast("string"), F.lit("h")))
    return c.select("conv_id", "turn", F.md5(key).alias("comment_key"))
