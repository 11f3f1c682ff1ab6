"""Text augmentation and synthesis (G1-G5, G7, G10, G16, G19, G20, G22,
G23).

Every random choice is ``u01(row key, seed, salt, k)``, so a row's variants
do not depend on partitioning or retries. Word operations work on a
projected word array; list edits use slice/concat, not per-element Python.
The synonym, template, filler and expression lists are small original
tables passed in as parameters.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hz
from ..functions import text as tx

# Own small, clean word lists (structure only mirrors the original kind).
SYNONYMS = {"good": ["fine", "nice"], "the": ["this"], "and": ["plus"], "of": ["from"],
            "is": ["seems"], "great": ["superb", "excellent"], "bad": ["poor"], "to": ["toward"]}
TEMPLATES = {"en": ["Note from the queue: {text}", "{text} (sent from the counter)", "Third report today: {text}", "Subject line said {text}", "{text} / end of message"],
             "vi": ["Ghi chú từ quầy: {text}", "{text} (gửi từ quầy)", "Báo cáo thứ ba hôm nay: {text}", "Tiêu đề ghi {text}", "{text} / hết tin"]}
EMOJIS = {2: ["😊", "👍", "🎉"], 1: ["😐", "🤔"], 0: ["😞", "😠"]}
EXPRESSIONS = {2: ["Love it", "Really nice"], 1: ["Not sure", "It is okay"], 0: ["Not happy", "Too bad"]}
PUNCT = {2: "!", 1: ".", 0: "..."}
TOPIC_TEMPLATES = {
    ("product", 2): ["The {item} works {adverb}", "Very happy with the {item}"],
    ("product", 1): ["The {item} is {adverb} average", "It is a {item}"],
    ("product", 0): ["The {item} broke {adverb}", "Not satisfied with the {item}"],
    ("service", 2): ["Staff were {adverb} helpful", "Great {item} support"],
    ("service", 1): ["The {item} was {adverb} standard", "Service as expected"],
    ("service", 0): ["Waited {adverb} long for the {item}", "Poor {item} handling"],
}
FILLERS = {"item": ["phone", "order", "screen", "delivery"], "adverb": ["quite", "really", "fairly"]}


def _arr(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def synonym_map() -> Column:
    return F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), _arr(v))])


def synonym_replacement(df: DataFrame, words: str, key: str, out: str, seed: int = 42) -> DataFrame:
    """G1 (n=1): a random distinct known word, a random synonym, a random
    occurrence of the word replaced. The chosen word is projected first so
    the occurrence scan's lambda reads a column, not a recomputed
    expression."""
    w, k = F.col(words), F.col(key)
    known = F.array_intersect(w, _arr(list(SYNONYMS)))
    d = df.withColumn("_known", known)
    d = d.withColumn("_cw", F.try_element_at(F.col("_known"), hz.pick_index(F.size("_known"), k, seed, "g1w") + 1))
    syns = F.try_element_at(synonym_map(), F.col("_cw"))
    syn = F.try_element_at(syns, hz.pick_index(F.size(syns), k, seed, "g1s") + 1)
    pos = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == F.col("_cw"))
    idx = F.try_element_at(pos, hz.pick_index(F.size(pos), k, seed, "g1p") + 1)
    res = F.concat(F.slice(w, 1, idx), F.array(syn), F.slice(w, idx + 2, F.size(w)))
    return d.withColumn(out, F.when(F.size("_known") > 0, res).otherwise(w)).drop("_known", "_cw")


def random_insertion(words: Column, key: Column, seed: int = 42) -> Column:
    """G2 (n=1): a synonym of a random dictionary word inserted at a random
    position 0..n."""
    keys = list(SYNONYMS)
    k = F.element_at(_arr(keys), hz.pick_index(len(keys), key, seed, "g2k") + 1)
    syns = F.element_at(synonym_map(), k)
    syn = F.element_at(syns, hz.pick_index(F.size(syns), key, seed, "g2s") + 1)
    idx = hz.pick_index(F.size(words) + 1, key, seed, "g2i")
    return F.concat(F.slice(words, 1, idx), F.array(syn), F.slice(words, idx + 1, F.size(words) + 1))


def random_swap(words: Column, key: Column, seed: int = 42) -> Column:
    """G3 (n=1): two distinct random positions swapped (n >= 2)."""
    n = F.size(words)
    a = hz.pick_index(n, key, seed, "g3a")
    b0 = hz.pick_index(n - 1, key, seed, "g3b")
    b = F.when(b0 >= a, b0 + 1).otherwise(b0)
    i, j = F.least(a, b), F.greatest(a, b)
    out = F.concat(F.slice(words, 1, i), F.array(F.get(words, j)), F.slice(words, i + 2, j - i - 1),
                   F.array(F.get(words, i)), F.slice(words, j + 2, n))
    return F.when(n >= 2, out).otherwise(words)


def random_deletion(words: Column, key: Column, seed: int = 42, p: float = 0.1) -> Column:
    """Keep word i when u01(key, i) > p; one word stays as is; if all
    are deleted, one random word remains."""
    kept = F.filter(words, lambda w, i: hz.u01(key, seed, "g4", i) > p)
    one = F.array(F.element_at(words, hz.pick_index(F.size(words), key, seed, "g4r") + 1))
    return (F.when(F.size(words) <= 1, words).when(F.size(kept) == 0, one).otherwise(kept))


def template_based(text: Column, key: Column, lang: str = "en", seed: int = 42) -> Column:
    """Text wrapped in a random sentence template."""
    ts = TEMPLATES["vi" if lang == "vi" else "en"]
    t = F.element_at(_arr(ts), hz.pick_index(len(ts), key, seed, "g5") + 1)
    return F.replace(t, F.lit("{text}"), text)


METHODS = ("synonym", "insert", "swap", "delete", "template")


def augment_rows(df: DataFrame, key: str, text_col: str, n_per_sample: int = 2, seed: int = 42, methods=METHODS) -> DataFrame:
    """The original (variant 0) and the variants of the first
    ``n_per_sample`` of ``methods``, label kept; an unknown method is passed over."""
    w = df.withColumn("_w", tx.split_ws(F.col(text_col)))
    w = synonym_replacement(w, "_w", key, "_syn", seed)
    k = F.col(key)
    made = {"synonym": lambda: F.array_join(F.col("_syn"), " "),
            "insert": lambda: F.array_join(random_insertion(F.col("_w"), k, seed), " "),
            "swap": lambda: F.array_join(random_swap(F.col("_w"), k, seed), " "),
            "delete": lambda: F.array_join(random_deletion(F.col("_w"), k, seed), " "),
            "template": lambda: template_based(F.col(text_col), k, "en", seed)}
    variants = [made[m]() for m in methods if m in made][:n_per_sample]
    allv = F.array(F.col(text_col), *variants)
    return w.select("*", F.posexplode(allv).alias("variant", "aug_text")).drop("_w", "_syn")


def add_emojis(text: Column, sentiment: Column, key: Column, seed: int = 42) -> Column:
    """30% of texts get a sentiment emoji, prefix or suffix."""
    out = text
    for s, es in EMOJIS.items():
        e = F.element_at(_arr(es), hz.pick_index(len(es), key, seed, "g10e") + 1)
        deco = F.when(hz.u01(key, seed, "g10side") < 0.5, F.concat(e, F.lit(" "), text)).otherwise(F.concat(text, F.lit(" "), e))
        out = F.when((sentiment == s) & (hz.u01(key, seed, "g10") <= 0.3), deco).otherwise(out)
    return out


def add_expression(text: Column, sentiment: Column, key: Column, seed: int = 42) -> Column:
    """30% get an expression; the prefix form lower-cases the text."""
    out = text
    for s, xs in EXPRESSIONS.items():
        x = F.element_at(_arr(xs), hz.pick_index(len(xs), key, seed, "g16x") + 1)
        deco = F.when(hz.u01(key, seed, "g16side") < 0.5, F.concat(x, F.lit(", "), F.lower(text))).otherwise(
            F.concat(text, F.lit(". "), x))
        out = F.when((sentiment == s) & (hz.u01(key, seed, "g16") <= 0.3), deco).otherwise(out)
    return out


def add_punctuation(text: Column, sentiment: Column, key: Column, seed: int = 42) -> Column:
    """40% get the sentiment's punctuation repeated 1-3 times."""
    reps = hz.pick_index(3, key, seed, "g19n") + 1
    out = text
    for s, p in PUNCT.items():
        out = F.when((sentiment == s) & (hz.u01(key, seed, "g19") <= 0.4), F.concat(text, F.repeat(F.lit(p), reps))).otherwise(out)
    return out


def fill_template(topic: Column, sentiment: Column, key: Column, seed: int = 42) -> Column:
    """Template chosen by (topic, sentiment), placeholders replaced by
    random fillers; an unknown topic falls back to the first topic."""
    topics = sorted({t for t, _ in TOPIC_TEMPLATES}, key=lambda t: list(dict.fromkeys(t for t, _ in TOPIC_TEMPLATES)).index(t))
    t_eff = F.when(topic.isin(topics), topic).otherwise(F.lit(topics[0]))
    chosen = None
    for (t, s), ts in TOPIC_TEMPLATES.items():
        pick = F.element_at(_arr(ts), hz.pick_index(len(ts), key, seed, "g20t") + 1)
        cond = (t_eff == t) & (sentiment == s)
        chosen = F.when(cond, pick) if chosen is None else chosen.when(cond, pick)
    out = chosen
    for name, fills in FILLERS.items():
        f = F.element_at(_arr(fills), hz.pick_index(len(fills), key, seed, f"g20{name}") + 1)
        out = F.replace(out, F.lit("{" + name + "}"), f)
    return F.regexp_replace(out, r"\{[A-Za-z0-9_]+\}", "")


def quota_table(df_n: DataFrame, topic_weights: dict, sentiment_ratios: dict) -> DataFrame:
    """G23 quotas: floor(floor(N * topic weight) * sentiment ratio) rows per
    (topic, sentiment); ``df_n`` holds one row with column N."""
    rows = []
    for t, tw in topic_weights.items():
        for s, sr in sentiment_ratios.items():
            rows.append(F.struct(F.lit(t).alias("topic"), F.lit(s).alias("sentiment"),
                                 F.floor(F.floor(F.col("N") * tw) * sr).cast("long").alias("count")))
    return df_n.select(F.explode(F.array(*rows)).alias("q")).select("q.*")


def quota_rows(quotas: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(topic, sentiment, i) for i = 1..count: the numbers are made in chunks that
    are dealt over tasks, so no quota is one task's work."""
    last = F.floor((F.col("count") - 1) / chunk).cast("long")
    cut = quotas.where("count > 0").select("topic", "sentiment", "count", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_c"))
    cut = cut.repartition("topic", "sentiment", "_c")
    return cut.select("topic", "sentiment", F.explode(F.sequence(F.col("_c") * chunk + 1, F.least((F.col("_c") + 1) * chunk, F.col("count")))).alias("i"))


# Own small informal-variant table (word -> variants; the first is used).
VARIANTS = {"you": ["u", "ya"], "are": ["r"], "the": ["da"], "and": ["n", "nd"], "to": ["2"], "for": ["4"]}


def variant(word: Column) -> Column:
    """The first informal variant of a word, or the word."""
    m = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.lit(v[0]))])
    return F.coalesce(F.element_at(m, F.lower(word)), word)


def variant_lookup(words: Column) -> Column:
    """Each word replaced by its first informal variant when it has one
    (a broadcast-free map literal lookup inside transform)."""
    return F.transform(words, variant)


def keep_deletion(words: Column, key: Column, seed: int = 42, keep: float = 0.9) -> Column:
    """Each word kept when u01(key, i) < keep; nothing left -> original."""
    kept = F.filter(words, lambda w, i: hz.u01(key, seed, "g14", i) < keep)
    return F.when(F.size(kept) == 0, words).otherwise(kept)


# Keyboard neighbours built by rule: left and right key on the same QWERTY row.
KEY_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
KEY_NEIGHBOURS = {r[i]: "".join(x for x in (r[i - 1] if i > 0 else "", r[i + 1] if i + 1 < len(r) else "") if x)
                  for r in KEY_ROWS for i in range(len(r))}


def typo(w: Column, i, key: Column, seed: int = 42, rate: float = 0.3) -> Column:
    """Word number ``i`` with, by chance, one non-first character replaced by a
    keyboard neighbour (when the character has one and the word 4 characters)."""
    nb = F.create_map(*[x for k, v in KEY_NEIGHBOURS.items() for x in (F.lit(k), F.lit(v))])
    pos = F.floor(hz.u01(key, seed, "g8p", i) * (F.length(w) - 1)).cast("int") + 1
    cands = F.element_at(nb, F.lower(F.substring(w, pos + 1, 1)))
    ch = F.substring(cands, F.floor(hz.u01(key, seed, "g8c", i) * F.length(cands)).cast("int") + 1, 1)
    new = F.concat(F.substring(w, 1, pos), ch, F.substr(w, pos + 2))
    hit = (F.length(w) >= 4) & (hz.u01(key, seed, "g8", i) <= rate) & cands.isNotNull()
    return F.when(hit, new).otherwise(w)


def apply_typos(words: Column, key: Column, seed: int = 42, rate: float = 0.3) -> Column:
    """Each word of 4+ characters gets a typo with probability ``rate``."""
    return F.transform(words, lambda w, i: typo(w, i, key, seed, rate))


def fill_placeholders(template: Column, fillers: Column) -> Column:
    """Every ``{name}`` in the template replaced by fillers[name], an
    unknown name by ''. The placeholders are scanned with one regex and
    folded with ``aggregate``."""
    names = F.regexp_extract_all(template, F.lit(r"\{([A-Za-z0-9_]+)\}"), 1)
    return F.aggregate(names, template, lambda acc, p: F.replace(
        acc, F.concat(F.lit("{"), p, F.lit("}")), F.coalesce(F.element_at(fillers, p), F.lit(""))))
