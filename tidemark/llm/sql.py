"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from .licences import TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM grams g JOIN win USING (n, s)),
words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(it, ',' ORDER BY it) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS it FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body,
    replace(replace(replace(replace(coalesce(role, 'unknown'), '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<|', '<\|') AS name, coalesce(role = 'system', false) AS scene FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) - 1 AS n FROM t),
v AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role IS NOT NULL AND trim(role) <> '' AND NOT scene),
b AS (
  SELECT n.conv_id, v.participant, CAST(n // 256 AS INTEGER) AS part, n, NOT scene AND speaker = participant AS own,
    CASE WHEN scene THEN '<|im_start|>' || name || chr(10) WHEN speaker = participant THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || name || chr(10) END AS head,
    body || '<|im_end|>' || chr(10) AS tail
  FROM n JOIN v ON n.conv_id IS NOT DISTINCT FROM v.conv_id),
a AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, participant, part ORDER BY n) AS e FROM b),
p AS (
  SELECT conv_id, participant, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own, CAST(max(e) AS BIGINT) AS n_chars,
    string_agg(head || tail, '' ORDER BY n) AS rendered,
    coalesce(string_agg(CAST(e - length(tail) AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY n) FILTER (own), '') AS mask
  FROM a GROUP BY ALL)
SELECT conv_id, participant, part, n_turns, n_own,
  CAST(coalesce(sum(n_chars) OVER (PARTITION BY conv_id, participant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  n_chars, rendered, mask
FROM p
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN degree ON x = d.doc_id
"""

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(range(k, k + 50)) AS x FROM win JOIN low USING (s) WHERE doc_id > m)),
words AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS x FROM d),
kept AS (
  SELECT doc_id, string_agg(v, ' ' ORDER BY x) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, x) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, len(d.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in TEMPLATES.items())
_WORDS = r"regexp_extract_all(translate(t, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LICENCES = rf"""
WITH templates(name, t) AS (VALUES {_TEMPLATES}),
bigrams AS (SELECT name, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS b FROM (SELECT name, {_WORDS} AS w FROM templates)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
parts AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n(?:[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n)+') AS s FROM documents)),
real_parts AS (SELECT doc_id, t, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (SELECT doc_id, t, i, len({_WORDS}) AS n FROM parts) WHERE n > 0),
reach AS (SELECT floor(max(len(b)) / (0.8::DOUBLE / 1.2::DOUBLE) + 1e-9) + 1 AS longest FROM bigrams),
runs AS (SELECT a.doc_id, a.k, b.k AS z FROM real_parts a JOIN real_parts b ON a.doc_id = b.doc_id AND a.k < b.k AND b.upto - a.upto + a.n <= (SELECT longest FROM reach)),
units AS (
  SELECT doc_id, t FROM lines
  UNION ALL SELECT doc_id, t FROM real_parts WHERE len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]'))) > 1
  UNION ALL SELECT doc_id, t FROM (SELECT r.doc_id, r.k, z, string_agg(t, ' ' ORDER BY p.k) AS t FROM runs r JOIN real_parts p ON p.doc_id = r.doc_id AND p.k BETWEEN r.k AND z GROUP BY ALL)),
numbered AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS w FROM units),
grams AS (SELECT u, doc_id, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS a FROM numbered WHERE len(w) > 1),
scored AS (
  SELECT u, doc_id, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM grams JOIN bigrams ON len(a) * 3 >= len(b) * 2 AND len(b) * 3 >= len(a) * 2),
best AS (SELECT doc_id, name, dice FROM scored WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY u ORDER BY dice DESC, name) = 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, '|' ORDER BY name) AS names, max(dice) AS top FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_units, coalesce(names, '') AS licences, coalesce(top, 0.0)::DOUBLE AS best_dice
FROM documents d LEFT JOIN found USING (doc_id)
"""

TOP_K = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
d AS (
  SELECT q.vec_id, r.vec_id AS neighbour, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(q.b[i] - r.b[i]))) AS INTEGER) AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS INTEGER) AS rank, neighbour, distance
FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) <= 10
"""

ORACLES = {
    "op6_license_scan": LICENCES,
    "op9_topk_search": TOP_K,
    "op3_substring_dedup": SUBSTRING,
    "op2_ngram_jaccard_join": JACCARD,
    "op5_decontamination": DECONTAMINATION,
    "op10_chat_format": CHAT,
}
