"""DuckDB SQL for the queries of the subpackage, where SQL can express them."""

ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (
  SELECT uid, source, pos, trim(parts[pos], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT uid, source, parts, unnest(generate_series(1, len(parts))) AS pos FROM d)),
bad AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
m AS (SELECT uid, pos, l.line, bad.line IS NOT NULL AS cut FROM l LEFT JOIN bad ON l.line = bad.line),
s AS (SELECT uid, count(*) FILTER (WHERE line <> '' AND NOT cut) > 0 AS mild FROM m GROUP BY uid),
k AS (
  SELECT uid, string_agg(parts[pos], chr(10) ORDER BY pos) FILTER (WHERE NOT (cut AND mild)) AS kept,
         count(*) FILTER (WHERE cut AND mild) AS n_removed
  FROM m JOIN s USING (uid) JOIN d USING (uid) GROUP BY uid)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
       CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k USING (uid)
"""

ORACLES["op8_preferences"] = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn,
         replace(replace(coalesce(role, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS role,
         replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i,
         '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body
  FROM t),
n AS (
  SELECT pair_id, count(*) FILTER (WHERE side = 0) AS n_chosen, count(*) FILTER (WHERE side = 1) AS n_rejected
  FROM r GROUP BY pair_id),
d AS (
  SELECT a.pair_id, min(a.i) AS first_other FROM r a JOIN r b
    ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
c AS (
  SELECT n.*, coalesce(first_other - 1, least(n_chosen, n_rejected)) AS n_common FROM n LEFT JOIN d USING (pair_id)),
x AS (
  SELECT r.*, n_common, head || body || chr(10) AS shown,
         length(head) || ':0,' || length(body) || ':' || CAST(role = 'assistant' AS INT) || ',1:0' AS mask
  FROM r JOIN c USING (pair_id))
SELECT c.pair_id, CAST(c.n_common AS BIGINT) AS n_common, CAST(n_chosen AS BIGINT) AS n_chosen,
       CAST(n_rejected AS BIGINT) AS n_rejected,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= x.n_common), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i > x.n_common), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 1 AND i > x.n_common), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE side = 0 AND i > x.n_common), '') AS chosen_mask,
       coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE side = 1 AND i > x.n_common), '') AS rejected_mask
FROM c JOIN x USING (pair_id) GROUP BY c.pair_id, c.n_common, n_chosen, n_rejected
"""

ORACLES["op10_decontaminate"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT uid, s, m, list_slice(w, s, s + m - 1) AS win
  FROM (SELECT uid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT uid, s, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
words AS (
  SELECT uid, count(DISTINCT p) AS n_hit
  FROM (SELECT uid, unnest(generate_series(s, s + m - 1)) AS p FROM (SELECT DISTINCT uid, s, m FROM hit)) GROUP BY uid),
names AS (
  SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN names USING (uid)
"""

ORACLES["op12_collocations"] = rf"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents)),
s AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p),
g AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS g, CAST(count(*) AS HUGEINT) AS f
  FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM g WHERE k > 1 AND f >= 10),
x AS (
  SELECT c.lang, c.g, c.a, cut, l.f AS l, r.f AS r, 1000000 * c.a * c.a // (l.f * r.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c) c
  JOIN g l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, cut)
  JOIN g r ON r.lang = c.lang AND r.g = list_slice(c.g, cut + 1, c.k)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM x) WHERE o = 1),
inside AS (
  SELECT lang, g, max(a) AS longer
  FROM (SELECT lang, list_slice(g, 1, 2) AS g, a FROM c WHERE k = 3
        UNION ALL SELECT lang, list_slice(g, 2, 3), a FROM c WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score,
         row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(array_to_string(b.g, ' '))) AS rank
  FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
