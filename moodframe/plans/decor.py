"""Deterministic decoration of driver texts for lexicon-sensitive queries.

The driver's documents carry no emotion keywords, emoji or emoticons; a
suffix chosen by ``u01(doc_id, ...)`` appends them the same way in Spark and
in the oracle SQL, so keyword and emoji features have something to count.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import lexicon as lx

DECOR_WORDS = [w for e in lx.EMOTION_KEYWORDS["en"].values() for w in e] + ["The", "OK", "the", "of"]
EMOJI_SUFFIX = " 😀🎉"
EMOTICON_SUFFIX = " :-) ;p :("
SHOUT_SUFFIX = " WOW!!! ?"

# Query parameters: word lists drawn from the corpus and the decoration.
POSITIVE = ["good", "great", "happy", "the", "and"]
NEGATIVE = ["sad", "down", "not", "of"]
LEXICON = POSITIVE + NEGATIVE


def decorate(text: Column, key: Column, seed: int = 7) -> Column:
    arr = F.array(*[F.lit(w) for w in DECOR_WORDS])
    n = len(DECOR_WORDS)
    w1 = F.element_at(arr, hz.pick_index(n, key, seed, "w", 1) + 1)
    w2 = F.element_at(arr, hz.pick_index(n, key, seed, "w", 2) + 1)
    s1 = F.when(hz.u01(key, seed, "emoji") < 0.3, F.lit(EMOJI_SUFFIX)).otherwise(F.lit(""))
    s2 = F.when(hz.u01(key, seed, "emoticon") < 0.3, F.lit(EMOTICON_SUFFIX)).otherwise(F.lit(""))
    s3 = F.when(hz.u01(key, seed, "shout") < 0.4, F.lit(SHOUT_SUFFIX)).otherwise(F.lit(""))
    return F.concat(text, F.lit(" "), w1, F.lit(" "), w2, s1, s2, s3)


def sql_decorate(text: str, key: str, seed: int = 7) -> str:
    arr = lx.sql_str_list(DECOR_WORDS)
    n = len(DECOR_WORDS)
    w1 = f"{arr}[{hz.sql_pick_index(str(n), key, seed, 'w', '1')} + 1]"
    w2 = f"{arr}[{hz.sql_pick_index(str(n), key, seed, 'w', '2')} + 1]"
    s1 = f"CASE WHEN {hz.sql_u01(key, seed, 'emoji')} < 0.3 THEN '{EMOJI_SUFFIX}' ELSE '' END"
    s2 = f"CASE WHEN {hz.sql_u01(key, seed, 'emoticon')} < 0.3 THEN '{EMOTICON_SUFFIX}' ELSE '' END"
    s3 = f"CASE WHEN {hz.sql_u01(key, seed, 'shout')} < 0.4 THEN '{SHOUT_SUFFIX}' ELSE '' END"
    return f"({text} || ' ' || {w1} || ' ' || {w2} || {s1} || {s2} || {s3})"
