"""Emotion scoring and picking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import lexicon as lx


def emotion_scores(text: Column, lang: str = "en") -> Column:
    """Map emotion -> normalised score.

    Per emotion, the number of its keywords that occur as substrings of the
    lower-cased text, times 1.2 when the text has '!'; scores are divided by
    their sum (sum 0 -> all 0). Keys follow the keyword-dictionary order."""
    kws = lx.keywords(lang)

    def raw(low: Column) -> Column:
        mult = F.when(F.instr(low, "!") > 0, F.lit(1.2)).otherwise(F.lit(1.0))
        hits = [sum((F.when(F.instr(low, w) > 0, 1).otherwise(0) for w in words), F.lit(0)) for words in kws.values()]
        return hz.let(mult, lambda m: F.array(*[h.cast("double") * m for h in hits]))
    # each step bound once: inside a lambda or a map nothing is shared by itself
    return hz.let(hz.let(F.lower(text), raw), lambda r: F.map_from_arrays(F.array(*[F.lit(e) for e in kws]), normalised(r)))


def normalised(values: Column) -> Column:
    """An array divided by its sum; a sum of 0 divides by 1."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return hz.let(total, lambda t: F.transform(values, lambda x: x / F.when(t == 0, F.lit(1.0)).otherwise(t)))


def _ranked(scores: Column, emotions) -> Column:
    return F.array(*[F.struct(F.element_at(scores, e).alias("score"), F.lit(-i).alias("neg_ord"),
                              F.lit(e).alias("emotion"), F.lit(s).alias("sentiment"))
                     for i, (e, s) in enumerate(emotions)])


def argmax_emotion(scores: Column) -> Column:
    """T4: arg-max key, ties -> first in dictionary order."""
    emos = [(e[0], e[2]) for e in lx.EMOTION_MAPPING]
    return F.array_max(_ranked(scores, emos)).getField("emotion")


def pick_emotion(scores: Column, sentiment: Column) -> Column:
    """Arg-max among the emotions of the predicted sentiment; ties and
    all-zero -> the first such emotion in order; no scores -> the first."""
    emos = [(e[0], e[2]) for e in lx.EMOTION_MAPPING]
    m = F.coalesce(scores, F.create_map().cast("map<string,double>"))
    # no lambda: the map is one common subexpression of generated code
    return F.array_max(F.array(*[F.when(sentiment == s, F.struct(F.coalesce(F.element_at(m, e), F.lit(0.0)).alias("score"), F.lit(-i).alias("neg_ord"), F.lit(e).alias("emotion")))
                                 for i, (e, s) in enumerate(emos)])).getField("emotion")


def attach_emotion_details(df: DataFrame, emotion_col: str = "emotion") -> DataFrame:
    """Emotion -> vi name and emoji, a broadcast join with the 12-row
    emotion dimension."""
    dim = lx.emotion_table(df.sparkSession).select(
        F.col("emotion").alias(emotion_col), "emotion_vi", "emotion_emoji")
    return df.join(F.broadcast(dim), emotion_col, "left")


def confidences(probs: Column) -> tuple[Column, Column]:
    """Sentiment confidence = max probability; emotion = 0.8x."""
    conf = F.array_max(probs)
    return conf, conf * F.lit(0.8)


def detailed_emotion(sentiment: Column, key, seed: int = 42) -> Column:
    """A fine emotion name chosen by hash within the sentiment group."""
    groups = {2: list(lx.EMOTION_LABELS["POSITIVE"].values()),
              0: list(lx.EMOTION_LABELS["NEGATIVE"].values()),
              1: list(lx.EMOTION_LABELS["NEUTRAL"].values())}
    out = None
    for s, names in groups.items():
        arr = F.array(*[F.lit(n) for n in names])
        pick = F.element_at(arr, hz.pick_index(len(names), key, seed, "fine") + 1)
        out = F.when(sentiment == s, pick) if out is None else out.when(sentiment == s, pick)
    return out.otherwise(F.element_at(F.array(*[F.lit(n) for n in groups[1]]),
                                      hz.pick_index(len(groups[1]), key, seed, "fine") + 1))
