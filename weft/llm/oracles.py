"""DuckDB statements for the operators whose whole result SQL can express."""

from __future__ import annotations

import re

from . import licenses

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{30,}|sk_live_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})"

SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
p(kind, rank, pattern) AS (VALUES ('assign', 0, '{_ASSIGN}'), ('access', 1, 'AKIA[A-Z0-9]{{14,}}'), ('hex', 2, '[0-9a-f]{{16,}}'), ('live', 3, '{_TOKEN}')),
m AS (SELECT r, doc_id, source, kind, rank, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g FROM d, p),
s AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
x AS (SELECT r, doc_id, source, kind, rank, m[i] AS v, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a FROM s),
c AS (SELECT r, doc_id, source, kind, rank, a, a + length(v) AS z, CASE WHEN kind = 'assign' THEN regexp_replace(v, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '') ELSE v END AS v FROM x),
f AS (SELECT * FROM c WHERE kind <> 'assign' OR length(v) >= 12),
o AS (SELECT v, count(DISTINCT (doc_id, source)) <= 3 AND count(DISTINCT coalesce('s' || source, 'n')) <= 1 AS live FROM f GROUP BY v),
j AS (SELECT f.*, live, kind || ':' || a || ':' || z AS span FROM f JOIN o USING (v)),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, rank) FILTER (kind <> 'live') AS base, string_agg(span, ',' ORDER BY a, rank) FILTER (kind <> 'live' OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (r)"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END)) AS g FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
q AS (SELECT a AS r, a AS o FROM e UNION SELECT q.r, e.b FROM q JOIN e ON e.a = q.o),
k AS (SELECT q.r, min(doc_id) AS component_id FROM q JOIN d ON d.r = q.o GROUP BY q.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT r, coalesce(doc_id::VARCHAR, '') || md5(h) AS holder, unnest(range(1, len(words) - 49)) AS i, unnest(list_transform(range(1, len(words) - 49), lambda i: md5(array_to_string(words[i:i + 50], ' ')))) AS g FROM d WHERE len(words) > 50),
u AS (SELECT r, i FROM g QUALIFY min(holder) OVER (PARTITION BY g) <> max(holder) OVER (PARTITION BY g)),
c AS (SELECT r, sum(span)::BIGINT AS words FROM (SELECT r, least(51, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 51)) AS span FROM u) GROUP BY r),
w AS (SELECT r, unnest(range(0, len(h) // 2 - 399)) AS i, unnest(list_transform(range(0, len(h) // 2 - 399), lambda i: md5(substr(h, 2 * i + 1, 800)))) AS g FROM d WHERE len(h) >= 800),
t AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY g) > 1),
b AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS fresh FROM t),
n AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM b),
s AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM n GROUP BY r, k),
p AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
q AS (SELECT r, sum(z - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front, max(z) AS last FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(c.words, 0) AS n_passage_words FROM d LEFT JOIN q USING (r) LEFT JOIN c USING (r)"""

CHAT = r"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT *, length(role) + length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) + length(regexp_replace(role, '[^<\[\\\n]', '', 'g')) + 24 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT row_number() OVER () AS r, * FROM d),
g3 AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM k),
r3 AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g3) WHERE c > 1) GROUP BY r),
g8 AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM k),
r8 AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g8) WHERE c > 1) GROUP BY r),
g151 AS (SELECT r, max(c) > 1 AS long FROM (SELECT r, count(*) AS c FROM (SELECT r, unnest(list_transform(range(1, len(w) - 149), lambda i: md5(array_to_string(w[i:i + 150], ' ')))) AS g FROM k WHERE r IN (SELECT r FROM r8)) GROUP BY r, g) GROUP BY r),
l AS (SELECT r, sum(c - 1)::BIGINT AS n FROM (SELECT r, l, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM k) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l) GROUP BY r),
a AS (SELECT k.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r3.n, 0) AS n_repeat_words, coalesce(r8.n, 0) / greatest(len(w), 1) AS covered_fraction, coalesce(long, false) AS long
FROM k LEFT JOIN l USING (r) LEFT JOIN r3 USING (r) LEFT JOIN r8 USING (r) LEFT JOIN g151 USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered_fraction <= 0.4 AND NOT long AS kept, covered_fraction FROM b"""


def _pattern(template: str) -> str:
    """A template as a regular expression over ' word word '."""
    out = []
    for token in re.findall(r"\[\[|\]\]|<<\d+-\d+>>|[^\s\[\]<>]+", template):
        if token == "[[":
            out.append("(?:")
        elif token == "]]":
            out.append(")?")
        elif token.startswith("<<"):
            out.append("(?: [^ ]+){%s,%s}" % tuple(token[2:-2].split("-")))
        else:
            out.append(f" {token}")
    return "".join(out) + " "


def _licenses() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
    found = " UNION ALL ".join(f"SELECT r, '{k}' AS label FROM w WHERE regexp_matches(flat, '{_pattern(v)}')" for k, v in licenses.TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, w, ' ' || array_to_string(w, ' ') || ' ' AS flat FROM d),
p(phrase, label) AS (VALUES {phrases}),
b AS (SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase)) AS place FROM w, p WHERE contains(flat, phrase)),
t AS ({found}),
g AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM t) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN r IN (SELECT r FROM t) THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END AS score
FROM d LEFT JOIN g USING (r) LEFT JOIN a USING (r)"""


ORACLES = {"op3_license_scan": _licenses(), "op5_chat_format": CHAT, "op6_jaccard_join": JACCARD, "op7_secret_scan": SECRETS, "op9_quality_rules": QUALITY, "op10_dedup_substrings": SUBSTRINGS}
