"""DuckDB SQL for the queries that SQL can express, over the whole tables."""
from __future__ import annotations

from . import line_dedup

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, s, w[i:i + s - 1] AS k FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM bs)),
ds AS (SELECT doc_id, w, s FROM d, (SELECT DISTINCT s FROM bw) WHERE len(w) >= s),
dw AS (SELECT doc_id, i, s, w[i:i + s - 1] AS k FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM ds)),
m AS (SELECT dw.doc_id, dw.i, dw.s, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM m GROUP BY doc_id),
bp AS (SELECT item_id, j, s, w[j:j + s - 1] AS k FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS j FROM bs)),
g AS (SELECT dw.doc_id, i, s, item_id, i - j AS diagonal, i - row_number() OVER (PARTITION BY dw.doc_id, item_id, i - j ORDER BY i) AS run FROM dw JOIN bp USING (s, k)),
x AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, count(*) + s - 1 AS n, min(i) - 1 AS start FROM g GROUP BY doc_id, item_id, s, diagonal, run),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item, start) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated,
  CAST(coalesce(l.n, 0) AS BIGINT) AS longest_match, l.item AS longest_item, CAST(l.start AS BIGINT) AS longest_at
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)"""

# a control string with any number of backslashes behind its first character
_CONTROL = r"<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>"

CHAT_FORMAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_SPACE = r"[\x20\x09-\x0D]+"


def _words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{_SPACE}'), lambda y: y <> '')"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, {_words('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT doc_id, i, w[i:i + 7] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, len({_words('x')}) AS n, regexp_replace(lower(array_to_string({_words('x')}, ' ')), '[0-9]+', '0', 'g') AS line
      FROM (SELECT doc_id, host, text, unnest(ls) AS x FROM w)),
held AS (SELECT host, line, count(DISTINCT text) AS held FROM l GROUP BY host, line HAVING count(DISTINCT text) >= 25),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
gone AS (SELECT doc_id, sum(l.n) AS n FROM l JOIN held USING (host, line) JOIN hosts USING (host) WHERE held > 0.05 * docs OR held >= 1000 GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM v"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (h)"""

SUFFIX_FAMILY = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 100, true) AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
x AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM r GROUP BY doc_id, run),
g AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM x GROUP BY doc_id),
e AS (SELECT d.doc_id, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, list_concat([0::BIGINT], coalesce(z, [])) AS starts,
        list_concat(coalesce(a, []), [CAST(length(h) // 2 AS BIGINT)]) AS ends FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(list_zip(starts, ends), lambda q: substr(h, CAST(2 * q[1] + 1 AS BIGINT), CAST(2 * (q[2] - q[1]) AS BIGINT))), ''))) AS kept_sha256 FROM e"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nn, sum(len(w))::BIGINT AS ll FROM d),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t, nn),
m AS (SELECT doc_id, r, 50 + ((50 * len(w) * nn) // ll) AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT item_id, r, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM b JOIN w USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM p JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50"""

ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op3_chat_format": CHAT_FORMAT,
    "op4_quality_rules": QUALITY_RULES,
    "op7_warc_chunks": WARC,
    "op8_suffix_family": SUFFIX_FAMILY,
    "op9_line_dedup": line_dedup.ORACLE,
    "op13_ranked_search": RANKED_SEARCH,
}
