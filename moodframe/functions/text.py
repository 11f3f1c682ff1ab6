"""Text column expressions (cleaning, tokens, small parsers).

Every function returns a Column built from Spark built-ins, so the work stays
inside whole-stage codegen. The only Python on the path is the Unicode NFC
step, which Spark lacks; it runs as an Arrow pandas UDF and is handed NULL
for every row whose code points are all below U+0300 (those are already NFC),
so almost no data crosses into Python.

Each ``sql_*`` twin returns the same expression as DuckDB SQL text for the
oracle queries. Character classes are spelled with ``\\p{..}`` because ``\\w``
and ``\\s`` mean different things in Java, RE2 and Python.
"""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as hz
from . import lexicon as lx

# Whitespace as Python's str.split()/isspace() sees it.
WS = r"\t\n\x0B\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
WS_RUN = f"[{WS}]+"
TAG = r"<[^>]+>"
NON_WORD = rf"[^\p{{L}}\p{{N}}_{WS}]"
DIGIT_UNDERSCORE = r"[\p{Nd}_]+"
BETWEEN_WORDS = r"[^\p{L}\p{Nl}\p{No}]+"     # what X3, X4 and the split take away, in one
NEEDS_NFC = r"[^\x{0}-\x{2FF}]"

# FIXED VALUES: letters that mark a text as Vietnamese.
VI_MARKED_LETTERS = (
    "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠàáâãèéêìíòóôõùúăđĩũơƯĂẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼỀỀỂưăạảấầẩẫậắằẳẵặẹẻẽềềểỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪễệỉịọỏốồổỗộớờởỡợụủứừỬỮỰỲỴÝỶỸửữựỳỵỷỹ"
)
# FIXED VALUES: reaction patterns (type, words), and comment-label patterns.
REACTION_PATTERNS = [
    ("like", "like|thích"), ("love", "love|yêu thích"), ("haha", "haha"),
    ("wow", "wow"), ("sad", "sad|buồn"), ("angry", "angry|phẫn nộ"),
]
AUTHOR_VI = r"(?i)^(?:Bình luận|Phản hồi|Trả lời) bởi (.+)\z"
AUTHOR_EN = r"(?i)^Comment by (.+)\z"
RELATIVE_TIME = r"(?i)^[0-9]+[hdmsy]\z"

# Default Vietnamese compounds that protect a stop word inside them. Own list.
VI_COMPOUNDS = ["có thể", "có lẽ", "trong khi", "trong nước", "được phép",
                "đã từng", "các bạn", "của cải", "này nọ"]


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else None)


@F.pandas_udf(T.StringType())
def _nfkd_strip_udf(s: pd.Series) -> pd.Series:
    def strip(run: re.Match) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", run[0]) if not unicodedata.combining(ch))
    # ASCII stays and no mark moves across it
    return s.map(lambda x: re.sub(r"[^\x00-\x7F]+", strip, x) if isinstance(x, str) else None)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- X1-X9 cleaning -------------------------------------------------------

def strip_tags(c) -> Column:                      # X1
    return F.regexp_replace(_c(c), TAG, "")


# Marked nondeterministic on purpose: it keeps filters that use the cleaned
# text from being pushed below a repartition into the scan task (the cleaner
# is the expensive step and must run after rows are spread), and stops the
# optimizer from inlining the UDF call twice.
_nfc_once = _nfc_udf.asNondeterministic()


def nfc(c) -> Column:                             # X2
    c = _c(c)
    return F.coalesce(_nfc_once(F.when(c.rlike(NEEDS_NFC), c)), c)


_nfkd_strip_once = _nfkd_strip_udf.asNondeterministic()


def strip_accents(c) -> Column:
    """NFKD then drop combining marks (only rows that have non-ASCII).
    Nondeterministic for the same reason as ``nfc``: evaluated once, in its
    own projection, never inlined into a lambda."""
    c = _c(c)
    return F.coalesce(_nfkd_strip_once(F.when(c.rlike(r"[^\x{0}-\x{7F}]"), c)), c)


def non_word_to_space(c) -> Column:               # X3
    return F.regexp_replace(_c(c), NON_WORD, " ")


def digits_to_space(c) -> Column:                 # X4
    return F.regexp_replace(_c(c), DIGIT_UNDERSCORE, " ")


def split_ws(c) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(_c(c), WS_RUN), lambda t: t != "")


def split_contractions(tokens: Column) -> Column:  # X6 (en)
    m = F.create_map(*[x for k, v in lx.EN_CONTRACTIONS.items()
                       for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    return F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(m, t), F.array(t))))


def split_contractions_in(words: Column) -> Column:
    """X6 on lower-cased words with a space between them."""
    def split(s: Column) -> Column:
        heads = "|".join(f"{a}(?={b}(?![^ ]))" for a, b in lx.EN_CONTRACTIONS.values())
        any_ = None
        for k in lx.EN_CONTRACTIONS:
            any_ = s.contains(k) if any_ is None else any_ | s.contains(k)
        return F.when(any_, F.regexp_replace(s, f"(?<![^ ])({heads})", "$1 ")).otherwise(s)
    return hz.let(words, split)


def remove_stop_words(tokens: Column, lang: str = "en", compat: bool = False,
                      compounds=None) -> Column:   # X7 + X8
    if lang != "vi":
        if compat:
            return F.filter(tokens, lambda t: ~F.lit(lx.EN_STOP_WORDS_COMPAT).contains(t))
        return F.filter(tokens, lambda t: ~t.isin(lx.EN_STOP_WORDS))
    sw = F.array(*[F.lit(w) for w in lx.VI_STOP_WORDS])
    cmp = F.array(*[F.lit(w) for w in (compounds if compounds is not None else VI_COMPOUNDS)])
    # Neighbours are zipped in first, so the lambdas below reference only
    # their own arguments (the token expression may hold the NFC UDF, which
    # cannot appear inside a lambda).
    n = F.size(tokens)
    none = F.array(F.lit(None).cast("string"))
    prev = F.concat(none, F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), none)
    trip = F.zip_with(F.zip_with(tokens, prev, lambda t, p: F.struct(t.alias("t"), p.alias("p"))),
                      nxt, lambda s, x: F.struct(s.getField("t").alias("t"), s.getField("p").alias("p"), x.alias("n")))

    def keep(z):
        t = z.getField("t")
        protected = F.coalesce(F.array_contains(cmp, F.concat(z.getField("p"), F.lit(" "), t)), F.lit(False)) | \
            F.coalesce(F.array_contains(cmp, F.concat(t, F.lit(" "), z.getField("n"))), F.lit(False))
        return t.isNotNull() & ((~F.array_contains(sw, t)) | protected)
    return F.transform(F.filter(trip, keep), lambda z: z.getField("t"))


def clean_tokens(c, lang: str = "en", compat: bool = False) -> Column:
    words = F.lower(F.regexp_replace(nfc(strip_tags(c)), BETWEEN_WORDS, " "))
    if lang != "vi":
        words = split_contractions_in(words)
    return remove_stop_words(F.filter(F.split(words, " "), lambda t: t != ""), lang, compat)


def clean_text(c, lang: str = "en", compat: bool = False) -> Column:
    """The full cleaner; tokens joined by one space."""
    return F.array_join(clean_tokens(c, lang, compat), " ")


def light_normalize(c) -> Column:                 # X9
    return F.lower(F.regexp_replace(_c(c), f"^{WS_RUN}|{WS_RUN}$", ""))


def py_strip(c) -> Column:
    return F.regexp_replace(_c(c), f"^{WS_RUN}|{WS_RUN}$", "")


# ---- X10-X16 small parsers --------------------------------------------------

def detect_language(c) -> Column:                 # X10
    c = _c(c)
    return F.when(c.rlike("[A-Za-z]"),
                  F.when(c.rlike(f"[{VI_MARKED_LETTERS}]"), "vi").otherwise("en")
                  ).otherwise("vi")


def reaction_counts(c) -> Column:                 # X11
    """struct<total INT, types MAP<STRING,INT>>; a number beyond INT doesn't count."""
    c = F.coalesce(_c(c), F.lit(""))
    counts = [(name, F.regexp_extract(c, f"(?i)([0-9]+)[{WS}]*({words})", 1)) for name, words in REACTION_PATTERNS]
    vals = [v.try_cast("int") for _, v in counts]
    types = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in counts]), F.array(*vals)),
                         lambda k, v: v.isNotNull())
    typed_total = F.aggregate(F.map_values(types), F.lit(0).cast("long"), lambda a, x: a + x).try_cast("int")
    first = F.regexp_extract(c, "([0-9]+)", 1)
    total = F.when(typed_total == 0, F.coalesce(first.try_cast("int"), F.lit(0))).otherwise(typed_total)
    return F.struct(total.alias("total"), types.alias("types"))


def first_integer(c) -> Column:                   # X12; null beyond BIGINT
    v = F.regexp_extract(_c(c), "[0-9]+", 0)
    return F.when(v != "", v.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def author_from_label(c) -> Column:               # X13
    c = _c(c)
    vi = F.regexp_extract(c, AUTHOR_VI, 1)
    en = F.regexp_extract(c, AUTHOR_EN, 1)
    name = py_strip(F.when(c.rlike(AUTHOR_VI), vi).when(c.rlike(AUTHOR_EN), en))
    return F.when(name != "", name)


def is_relative_time(c) -> Column:                # X14
    return F.coalesce(py_strip(_c(c)).rlike(RELATIVE_TIME), F.lit(False))


def relative_time_seconds(c) -> Column:
    t = F.lower(py_strip(_c(c)))
    n = F.regexp_extract(t, "^([0-9]+)", 1).try_cast("bigint")     # null beyond BIGINT
    unit = F.substring(t, -1, 1)
    mult = (F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600)
            .when(unit == "d", 86400).when(unit == "y", 31536000))
    return F.when(t.rlike(RELATIVE_TIME), F.try_multiply(n, mult))


def is_reply_markup(c) -> Column:                 # X15
    return F.coalesce(_c(c).rlike(r'reply_comment_id|aria-label="[^"]*(Reply|Trả lời)|style="[^"]*(margin-left|padding-left)'),
                      F.lit(False))


def comment_key(author, text, rel_time) -> Column:  # X16
    return F.concat_ws("-", _c(author), _c(text), _c(rel_time))


# ---- DuckDB twins ---------------------------------------------------------

def sql_strip_tags(e: str) -> str:
    return f"regexp_replace({e}, '{TAG}', '', 'g')"


def sql_split_ws(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS_RUN}'), lambda t: t <> '')"


def sql_split_contractions(tokens: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {lx.sql_str_list(v)}" for k, v in lx.EN_CONTRACTIONS.items())
    return f"flatten(list_transform({tokens}, lambda t: CASE t {cases} ELSE [t] END))"


def sql_remove_stop_words(tokens: str, lang: str = "en", compat: bool = False, compounds=None) -> str:
    if lang != "vi":
        if compat:
            return f"list_filter({tokens}, lambda t: NOT contains('english', t))"
        return f"list_filter({tokens}, lambda t: NOT list_contains({lx.sql_str_list(lx.EN_STOP_WORDS)}, t))"
    sw = lx.sql_str_list(lx.VI_STOP_WORDS)
    cmp = lx.sql_str_list(compounds if compounds is not None else VI_COMPOUNDS)
    tk = tokens
    return (f"list_filter({tk}, lambda t, i: NOT list_contains({sw}, t) "
            f"OR coalesce(list_contains({cmp}, CASE WHEN i > 1 THEN {tk}[i - 1] || ' ' || t END), false) "
            f"OR coalesce(list_contains({cmp}, CASE WHEN i < len({tk}) THEN t || ' ' || {tk}[i + 1] END), false))")


def sql_clean_tokens(e: str, lang: str = "en", compat: bool = False) -> str:
    x = f"nfc_normalize({sql_strip_tags(e)})"
    x = f"regexp_replace({x}, '{NON_WORD}', ' ', 'g')"
    x = f"regexp_replace({x}, '{DIGIT_UNDERSCORE}', ' ', 'g')"
    tokens = sql_split_ws(f"lower({x})")
    if lang != "vi":
        tokens = sql_split_contractions(tokens)
    return sql_remove_stop_words(tokens, lang, compat)


def sql_clean_text(e: str, lang: str = "en", compat: bool = False) -> str:
    return f"array_to_string({sql_clean_tokens(e, lang, compat)}, ' ')"


def sql_py_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS_RUN}|{WS_RUN}$', '', 'g')"


def sql_detect_language(e: str) -> str:
    return (f"CASE WHEN regexp_matches({e}, '[A-Za-z]') THEN "
            f"CASE WHEN regexp_matches({e}, '[{VI_MARKED_LETTERS}]') THEN 'vi' ELSE 'en' END ELSE 'vi' END")


# ---- P16 post URLs -----------------------------------------------------------

# FIXED VALUES: post-URL patterns and post-id patterns (first match wins).
POST_URL_PATTERNS = [
    r"facebook\.com/[^/]+/posts/[0-9]+",
    r"facebook\.com/[^/]+/permalink/[0-9]+",
    r"facebook\.com/[^/]+/photos/[^/]+/[0-9]+",
    r"facebook\.com/photo\.php\?fbid=[0-9]+",
    r"facebook\.com/[^/]+/videos/[0-9]+",
    r"facebook\.com/video\.php\?v=[0-9]+",
    r"facebook\.com/[^/]+\?story_fbid=[0-9]+",
]
POST_ID_PATTERNS = [
    r"/posts/([0-9]+)",
    r"/permalink/([0-9]+)",
    r"\?story_fbid=([0-9]+)",
    r"/photo\.php\?fbid=([0-9]+)",
    r"/video\.php\?v=([0-9]+)",
    r"/([0-9]+)/?(?:\?|$)",
]


def is_post_url(c) -> Column:
    return F.coalesce(_c(c).rlike("|".join(f"(?:{p})" for p in POST_URL_PATTERNS)), F.lit(False))


def post_id(c) -> Column:
    c = _c(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in POST_ID_PATTERNS])


def sql_is_post_url(e: str) -> str:
    pat = "|".join(f"(?:{p})" for p in POST_URL_PATTERNS)
    return f"coalesce(regexp_matches({e}, '{pat}'), false)"


def sql_post_id(e: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({e}, '{p}', 1), '')" for p in POST_ID_PATTERNS) + ")"
