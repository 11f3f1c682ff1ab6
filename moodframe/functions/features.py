"""Hand-made text features as named DOUBLE/BIGINT columns.

Statistical (F1-F24), linguistic (L1-L6) and emotion (E1-E15) features are
per-row expressions over whitespace words; membership tests use literal sets
for bounded word lists (lexicons and keyword lists are small and fixed). What
needs the words is one array of counts for a text, so a text is split once.
``lexicon_hits`` is the join form for a lexicon table of any size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as hz
from . import lexicon as lx
from . import text as tx
from .text import WS

DIGITS = (r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
          r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}"
          r"\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}]")
EMOJI = r"[\x{1F300}-\x{1F9FF}]"
FACE_EMOJI = r"[\x{1F600}-\x{1F64F}]"
POS_EMOTICON = r"[:;]-?[)pP]"
NEG_EMOTICON = r"[:;]-?[(]"
ALL_CAPS_WORD = (r"\p{Lu}", r"[\p{Ll}\p{Lt}]")

STAT_COLS = ["f1_chars", "f2_words", "f3_avg_word_len", "f4_unique_chars", "f5_digits", "f6_upper",
             "f7_spaces", "f8_special", "f9_lexicon_ratio", "f10_exclaim", "f11_question", "f12_emoji",
             "f13_caps_word_ratio", "f14_word_len_var", "f15_pos_ratio", "f16_neg_ratio",
             "f17_exclaim_runs", "f18_question_runs", "f19_caps_ratio", "f20_pos_emoticons",
             "f21_neg_emoticons", "f22_face_emoji", "f23_pos_ratio", "f24_neg_ratio"]
LING_COLS = ["l1_sentences", "l2_words_per_sentence", "l3_mean_word_len", "l4_punct_ratio",
             "l5_capital_ratio", "l6_stop_ratio"]
EMO_COLS = [f"e_{e}" for e in lx.EMOTIONS_SORTED] + ["e13_exclaim_ratio", "e14_question_ratio", "e15_emoji_ratio"]


def count_in(words: Column, vocab) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(list(vocab)))) if vocab else F.size(words) * 0


def ratio(x: Column, n: Column) -> Column:
    return x.cast("double") / F.greatest(n, F.lit(1)).cast("double")


def _is_caps(w: Column) -> Column:
    return w.rlike(ALL_CAPS_WORD[0]) & ~w.rlike(ALL_CAPS_WORD[1])


def _variance(n: Column, s: Column, ss: Column) -> Column:
    """Population variance from exact integer sums: (n*sum(x^2) - sum(x)^2) / n^2;
    0 when there are no words."""
    return F.when(n > 0, (n * ss - s * s).cast("double") / (n * n).cast("double")).otherwise(F.lit(0.0))


def _non_blank(text: Column) -> Column:
    """Code points of all words."""
    return F.length(text) - F.regexp_count(text, F.lit(f"[{WS}]"))


def statistical(text: Column, lexicon=(), positive=(), negative=()) -> list[Column]:
    def counts(words: Column) -> Column:
        squares = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w) * F.length(w))
        own = F.size(words), F.size(F.filter(words, _is_caps)), *(count_in(words, v) for v in (lexicon, positive, negative)), squares
        return F.array(*[c.cast("bigint") for c in own])
    got = hz.let(tx.split_ws(text), counts)
    n, n_caps, n_lexicon, n_pos, n_neg, squares = (got[i] for i in range(6))
    length = F.length(text)
    caps, pos, neg = ratio(n_caps, n), ratio(n_pos, n), ratio(n_neg, n)
    cols = [
        length.cast("bigint"), n, ratio(length, n),
        F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1))).cast("bigint"),
        F.regexp_count(text, F.lit(DIGITS)).cast("bigint"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint"),
        F.regexp_count(text, F.lit(f"[{WS}]")).cast("bigint"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}]")).cast("bigint"),
        ratio(n_lexicon, n),
        F.regexp_count(text, F.lit("!")).cast("bigint"),
        F.regexp_count(text, F.lit(r"\?")).cast("bigint"),
        F.regexp_count(text, F.lit(EMOJI)).cast("bigint"),
        caps, _variance(n, _non_blank(text).cast("bigint"), squares), pos, neg,
        F.regexp_count(text, F.lit("!+")).cast("bigint"),
        F.regexp_count(text, F.lit(r"\?+")).cast("bigint"),
        caps,
        F.regexp_count(text, F.lit(POS_EMOTICON)).cast("bigint"),
        F.regexp_count(text, F.lit(NEG_EMOTICON)).cast("bigint"),
        F.regexp_count(text, F.lit(FACE_EMOJI)).cast("bigint"),
        pos, neg,
    ]
    return [c.alias(a) for c, a in zip(cols, STAT_COLS)]


def linguistic(text: Column, lang: str = "en") -> list[Column]:
    n = F.regexp_count(text, F.lit(f"[^{WS}]+"))
    length = F.length(text)
    sentences = F.regexp_count(text, F.lit(f"[^.{WS}][^.]*"))      # between full stops, not blank
    cols = [
        sentences.cast("bigint"), ratio(n, sentences), ratio(_non_blank(text), n),
        ratio(F.regexp_count(text, F.lit("[.,!?;:]")), length),
        ratio(F.regexp_count(text, F.lit(r"\p{Lu}")), length),
        ratio(count_in(F.split(F.lower(text), tx.WS_RUN), lx.stop_words(lang)), n),
    ]
    return [c.alias(a) for c, a in zip(cols, LING_COLS)]


def emotion(text: Column, lang: str = "en") -> list[Column]:
    low = F.lower(text)
    n = F.regexp_count(low, F.lit(f"[^{WS}]+"))
    length = F.length(low)
    kws = lx.keywords(lang)
    known = F.filter(F.split(low, tx.WS_RUN), lambda w: w.isin(sorted({w for e in kws for w in kws[e]})))
    got = hz.let(known, lambda words: F.array(*[count_in(words, kws[e]) for e in lx.EMOTIONS_SORTED]))
    cols = [ratio(got[i], n).alias(f"e_{e}") for i, e in enumerate(lx.EMOTIONS_SORTED)]
    cols += [ratio(F.regexp_count(low, F.lit("!")), length).alias("e13_exclaim_ratio"),
             ratio(F.regexp_count(low, F.lit(r"\?")), length).alias("e14_question_ratio"),
             ratio(F.regexp_count(low, F.lit(EMOJI)), length).alias("e15_emoji_ratio")]
    return cols


def lexicon_hits(df: DataFrame, key: str, words_col: str, lexicon: DataFrame,
                 word_col: str = "word", broadcast_max_rows: int = 1_000_000) -> DataFrame:
    """J1 join form: (key, hits) = number of words of each row found in
    ``lexicon``. The lexicon is broadcast only when its row count is under
    ``broadcast_max_rows``; otherwise both sides shuffle on the word."""
    lex = lexicon.select(F.col(word_col).alias("_w")).distinct()
    n_lex = lex.count()
    lex = F.broadcast(lex) if n_lex <= broadcast_max_rows else lex
    exploded = df.select(key, F.explode(words_col).alias("_w"))
    exploded = exploded.groupBy(key, "_w").agg(F.count(F.lit(1)).alias("_n"))      # a word of a row once
    hits = exploded.join(lex, "_w", "left_semi").groupBy(key).agg(F.sum("_n").alias("hits"))
    return (df.select(key).join(hits, key, "left")
              .select(key, F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits")))


def mean_word_vector(df: DataFrame, key: str, text_col: str, vectors: DataFrame,
                     word_col: str = "word", vec_col: str = "vec", dim: int | None = None, word_of=None, broadcast_max: int = 100_000) -> DataFrame:
    """V1: mean vector of the known lower-cased words; zero vector if none.

    ``word_of`` maps the words to the keys ``word_col`` of ``vectors``. Up to
    ``broadcast_max`` vectors are broadcast and a row's words are summed where they
    stand: a row of sums per text is all that is shuffled. Of more, a text and word
    are one row with their count before a vector is joined, and a word in very many
    rows is split by the skew join. The mean is a sum per coordinate, a partial
    aggregate over plain doubles, so no group is ever collected into a list."""
    dim = dim or (vectors.agg(F.max(F.size(vec_col))).first()[0] or 0)
    words = df.select(key, F.explode(tx.split_ws(F.lower(F.col(text_col)))).alias("_w")).select(key, (word_of(F.col("_w")) if word_of else F.col("_w")).alias(word_col))
    known = vectors.select(word_col, F.col(vec_col).alias("_v"))
    if known.limit(broadcast_max + 1).count() <= broadcast_max:
        known, words = F.broadcast(known), words.withColumn("_tf", F.lit(1.0))
    else:
        words = words.groupBy(key, word_col).agg(F.count(F.lit(1)).cast("double").alias("_tf"))
    hit = words.join(known, word_col, "inner")
    sums = hit.groupBy(key).agg(F.sum("_tf").alias("_n"), *[F.sum(F.col("_v")[i].cast("double") * F.col("_tf")).alias(f"_s{i}") for i in range(dim)])
    means = sums.select(key, F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(dim)]).cast("array<double>").alias("_m"))
    zero = F.array_repeat(F.lit(0.0), dim) if dim else F.array().cast("array<double>")
    return (df.select(key).join(means, key, "left")
              .select(key, F.coalesce(F.col("_m"), zero).alias("mean_vec")))
