"""DuckDB twins of the feature expressions (oracle side only)."""
from __future__ import annotations

from ..functions import features as fx
from ..functions import lexicon as lx
from ..functions import text as tx
from .sqlparts import r6


def words(t: str) -> str:
    return tx.sql_split_ws(t)


def cnt(t: str, pat: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '{pat}')) AS BIGINT)"


def ratio(x: str, n: str, rounded: bool = True) -> str:
    e = f"CAST({x} AS DOUBLE) / CAST(greatest({n}, 1) AS DOUBLE)"
    return r6(e) if rounded else f"({e})"


def count_in(ws: str, vocab) -> str:
    if not vocab:
        return "0"
    return f"len(list_filter({ws}, lambda w: list_contains({lx.sql_str_list(vocab)}, w)))"


def statistical(t: str, lexicon=(), positive=(), negative=()) -> list[str]:
    ws = words(t)
    n = f"len({ws})"
    caps = ratio(f"len(list_filter({ws}, lambda w: regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]')))", n)
    pos = ratio(count_in(ws, positive), n)
    neg = ratio(count_in(ws, negative), n)
    s = f"list_sum(list_transform({ws}, lambda w: CAST(length(w) AS BIGINT)))"
    ss = f"list_sum(list_transform({ws}, lambda w: CAST(length(w) AS BIGINT) * length(w)))"
    var = r6(f"CASE WHEN {n} > 0 THEN CAST({n} * {ss} - {s} * {s} AS DOUBLE) / CAST({n} * {n} AS DOUBLE) ELSE 0.0 END")
    cols = [
        f"CAST(length({t}) AS BIGINT)", f"CAST({n} AS BIGINT)", ratio(f"length({t})", n),
        f"CAST(len(list_distinct(regexp_extract_all({t}, '(?s)(.)', 1))) AS BIGINT)",
        cnt(t, fx.DIGITS), cnt(t, r"\p{Lu}"), cnt(t, f"[{tx.WS}]"), cnt(t, r"[^\p{L}\p{N}]"),
        ratio(count_in(ws, lexicon), n), cnt(t, "!"), cnt(t, r"\?"), cnt(t, fx.EMOJI),
        caps, var, pos, neg, cnt(t, "!+"), cnt(t, r"\?+"), caps,
        cnt(t, fx.POS_EMOTICON), cnt(t, fx.NEG_EMOTICON), cnt(t, fx.FACE_EMOJI), pos, neg,
    ]
    return [f"{c} AS {a}" for c, a in zip(cols, fx.STAT_COLS)]


def linguistic(t: str, lang: str = "en", rounded: bool = True) -> list[str]:
    ws = words(t)
    n = f"len({ws})"
    sentences = f"len(list_filter(string_split({t}, '.'), lambda p: regexp_matches(p, '[^{tx.WS}]')))"
    letters = f"coalesce(list_sum(list_transform({ws}, lambda w: CAST(length(w) AS BIGINT))), 0)"
    sw = lx.sql_str_list(lx.stop_words(lang))
    cols = [
        f"CAST({sentences} AS BIGINT)", ratio(n, sentences, rounded), ratio(letters, n, rounded),
        ratio(f"len(regexp_extract_all({t}, '[.,!?;:]'))", f"length({t})", rounded),
        ratio(f"len(regexp_extract_all({t}, '\\p{{Lu}}'))", f"length({t})", rounded),
        ratio(f"len(list_filter({ws}, lambda w: list_contains({sw}, lower(w))))", n, rounded),
    ]
    return [f"{c} AS {a}" for c, a in zip(cols, fx.LING_COLS)]


def emotion(t: str, lang: str = "en", rounded: bool = True) -> list[str]:
    low = f"lower({t})"
    ws = words(low)
    n = f"len({ws})"
    kws = lx.keywords(lang)
    cols = [f"{ratio(count_in(ws, kws[e]), n, rounded)} AS e_{e}" for e in lx.EMOTIONS_SORTED]
    cols += [f"{ratio(f'len(regexp_extract_all({low}, {chr(39)}!{chr(39)}))', f'length({low})', rounded)} AS e13_exclaim_ratio",
             f"{ratio(f'len(regexp_extract_all({low}, {chr(39)}[?]{chr(39)}))', f'length({low})', rounded)} AS e14_question_ratio",
             f"{ratio(f'len(regexp_extract_all({low}, {chr(39)}{fx.EMOJI}{chr(39)}))', f'length({low})', rounded)} AS e15_emoji_ratio"]
    return cols


def emotion_score_parts(t: str, lang: str = "en") -> tuple[list[tuple[str, str]], str]:
    """(emotion, raw score) pairs and the denominator, as in M18."""
    low = f"lower({t})"
    mult = f"(CASE WHEN contains({low}, '!') THEN CAST(1.2 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)"
    raw = []
    for e, wds in lx.keywords(lang).items():
        hits = " + ".join(f"(CASE WHEN contains({low}, '{w}') THEN 1 ELSE 0 END)" for w in wds)
        raw.append((e, f"(CAST(({hits}) AS DOUBLE) * {mult})"))
    total = " + ".join(s for _, s in raw)
    denom = f"(CASE WHEN ({total}) = 0 THEN 1.0 ELSE ({total}) END)"
    return raw, denom
