"""Fixed values and small dimension tables.

Everything under "FIXED VALUES" must equal the values of the system this
library reproduces, so that features, label mappings and emotion picks give
the same answers. They are stated plainly and in their natural order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

# Vietnamese stop words.
VI_STOP_WORDS = ["và", "của", "các", "có", "được", "trong", "đã", "này"]

# English stop words (the public NLTK English list, 179 words).
EN_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom "
    "this that that'll these those am is are was were be been being have has "
    "had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan "
    "shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't"
).split()

# The English configuration names its stop-word list by the string
# "english"; the compatibility mode tests membership as a substring of it.
EN_STOP_WORDS_COMPAT = "english"

# Fused forms the English word tokenizer splits in two.
EN_CONTRACTIONS = {
    "cannot": ["can", "not"],
    "gimme": ["gim", "me"],
    "gonna": ["gon", "na"],
    "gotta": ["got", "ta"],
    "lemme": ["lem", "me"],
    "wanna": ["wan", "na"],
}

# Fine emotion label ids, grouped by sentiment (2 positive, 0 negative,
# 1 neutral).
EMOTION_LABELS = {
    "POSITIVE": {2: "positive", 3: "excited", 4: "happy", 5: "satisfied", 6: "impressed"},
    "NEGATIVE": {0: "negative", 7: "angry", 8: "disappointed", 9: "frustrated", 10: "worried"},
    "NEUTRAL": {1: "neutral", 11: "confused", 12: "uncertain", 13: "mixed"},
}

EMOTION_TO_SENTIMENT = {
    "excited": 2, "happy": 2, "satisfied": 2, "impressed": 2, "positive": 2,
    "angry": 0, "disappointed": 0, "frustrated": 0, "worried": 0, "negative": 0,
    "confused": 1, "uncertain": 1, "mixed": 1, "neutral": 1,
}

# Emotion dimension, in its natural order: name, id, sentiment, vi, emoji.
EMOTION_MAPPING = [
    ("happy", 2.1, 2, "vui vẻ", "😊"),
    ("excited", 2.2, 2, "phấn khích", "🤗"),
    ("satisfied", 2.3, 2, "hài lòng", "😌"),
    ("proud", 2.4, 2, "tự hào", "😊"),
    ("neutral", 1.0, 1, "bình thường", "😐"),
    ("surprised", 1.1, 1, "ngạc nhiên", "😮"),
    ("confused", 1.2, 1, "bối rối", "😕"),
    ("sad", 0.1, 0, "buồn", "😢"),
    ("angry", 0.2, 0, "giận dữ", "😠"),
    ("disappointed", 0.3, 0, "thất vọng", "😞"),
    ("frustrated", 0.4, 0, "bực bội", "😤"),
    ("worried", 0.5, 0, "lo lắng", "😟"),
]

# Emotion keywords per language, emotions in their natural order.
EMOTION_KEYWORDS = {
    "vi": {
        "happy": ["vui", "hạnh phúc", "thích", "tuyệt vời", "tốt", "thú vị"],
        "excited": ["phấn khích", "hào hứng", "tuyệt quá", "wow"],
        "satisfied": ["hài lòng", "thoải mái", "ổn", "được"],
        "proud": ["tự hào", "xuất sắc", "giỏi"],
        "neutral": ["bình thường", "tạm", "okay"],
        "surprised": ["ngạc nhiên", "bất ngờ", "không ngờ"],
        "confused": ["bối rối", "không hiểu", "lạ"],
        "sad": ["buồn", "khổ", "chán", "thương"],
        "angry": ["giận", "tức", "khó chịu", "ghét"],
        "disappointed": ["thất vọng", "không được", "kém"],
        "frustrated": ["bực", "khó chịu", "phiền"],
        "worried": ["lo", "sợ", "không an tâm"],
    },
    "en": {
        "happy": ["happy", "joyful", "pleased", "delighted", "good", "great"],
        "excited": ["excited", "thrilled", "eager", "enthusiastic", "wow"],
        "satisfied": ["satisfied", "content", "pleased", "okay", "fine"],
        "proud": ["proud", "accomplished", "successful", "confident"],
        "neutral": ["neutral", "indifferent", "unaffected", "okay"],
        "surprised": ["surprised", "shocked", "amazed", "astonished"],
        "confused": ["confused", "puzzled", "perplexed", "baffled"],
        "sad": ["sad", "unhappy", "down", "depressed", "miserable"],
        "angry": ["angry", "mad", "furious", "irritated", "annoyed"],
        "disappointed": ["disappointed", "dissatisfied", "unhappy", "let down"],
        "frustrated": ["frustrated", "annoyed", "irritated", "exasperated"],
        "worried": ["worried", "concerned", "anxious", "nervous", "apprehensive"],
    },
}

# Sentiment code names (bilingual).
SENTIMENT_NAMES = {0: "negative", 1: "neutral", 2: "positive"}
SENTIMENT_NAMES_VI = {0: "Tiêu cực", 1: "Trung tính", 2: "Tích cực"}

# Alert thresholds: the live set and the shadowed set.
ALERT_THRESHOLDS = [
    ("accuracy", 0.8, "min"), ("precision", 0.8, "min"), ("recall", 0.8, "min"),
    ("error_rate", 0.1, "max"), ("response_time", 1.0, "max"), ("memory_usage", 0.8, "max"),
]

# Early-stopping parameters and checkpoint retention.
EARLY_STOP_PATIENCE = 5
EARLY_STOP_MIN_DELTA = 0.0005
MAX_CHECKPOINTS = 5

# Ensemble soft-vote weights (forest, linear SVM, naive Bayes).
ENSEMBLE_WEIGHTS = [0.4, 0.3, 0.3]

# Composite score weights.
SCORE_WEIGHTS = {"precision": 0.4, "recall": 0.4, "f1": 0.2}

# ---------------------------------------------------------------------------

EMOTION_ORDER = [e[0] for e in EMOTION_MAPPING]
EMOTIONS_SORTED = sorted(EMOTION_ORDER)


def stop_words(lang: str) -> list[str]:
    return VI_STOP_WORDS if lang == "vi" else EN_STOP_WORDS


def keywords(lang: str) -> dict[str, list[str]]:
    return EMOTION_KEYWORDS["vi" if lang == "vi" else "en"]


def fine_label_table(spark: SparkSession) -> DataFrame:
    """(id, name, sentiment) for the 14 fine emotion labels."""
    group_sent = {"POSITIVE": 2, "NEGATIVE": 0, "NEUTRAL": 1}
    rows = [(i, n, group_sent[g]) for g, m in EMOTION_LABELS.items() for i, n in m.items()]
    schema = "id INT, name STRING, sentiment INT"
    return spark.createDataFrame(rows, schema)


def emotion_table(spark: SparkSession) -> DataFrame:
    rows = [(n, i, float(eid), s, vi, emo) for i, (n, eid, s, vi, emo) in enumerate(EMOTION_MAPPING)]
    schema = "emotion STRING, ord INT, emotion_id DOUBLE, sentiment INT, emotion_vi STRING, emotion_emoji STRING"
    return spark.createDataFrame(rows, schema)


def keyword_table(spark: SparkSession, lang: str | None = None) -> DataFrame:
    """(lang, emotion, keyword) rows; keywords may contain spaces."""
    rows = []
    for lg, emo in EMOTION_KEYWORDS.items():
        if lang and lg != lang:
            continue
        for e, kws in emo.items():
            for kw in kws:
                rows.append((lg, e, kw))
    return spark.createDataFrame(rows, "lang STRING, emotion STRING, keyword STRING")


def word_table(spark: SparkSession, words, col: str = "word") -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], T.StructType([T.StructField(col, T.StringType())]))


# ---- SQL fragments for the oracle ----------------------------------------

def sql_str_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
