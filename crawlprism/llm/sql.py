"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(range(1, len(parts) + 1)) AS i, parts
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), parts AS (
  SELECT doc_id, text, i, parts[i] AS part, regexp_matches(parts[i], '[^\x20\x09-\x0D]') AS has_word FROM raw
), owned AS (
  SELECT *, greatest(1, sum(has_word::INT) OVER (PARTITION BY doc_id ORDER BY i)) AS line FROM parts
), lines AS (
  SELECT doc_id, line - 1 AS line, string_agg(part, chr(10) ORDER BY i) AS body,
         max(CASE WHEN has_word THEN trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END) AS key
  FROM owned GROUP BY doc_id, line
  HAVING bool_or(has_word)
), windows AS (
  SELECT doc_id, line, key, lead(key) OVER w AS key2, lead(key, 2) OVER w AS key3
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), later AS (
  SELECT doc_id, line FROM windows WHERE key3 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key, key2, key3 ORDER BY doc_id, line) > 1
), gone AS (
  SELECT DISTINCT doc_id, line + unnest([0, 1, 2]) AS line FROM later
), result AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
         string_agg(l.body, chr(10) ORDER BY l.line) FILTER (g.line IS NULL) AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(r.n_removed, 0) = 0 THEN d.text ELSE coalesce(r.kept, '') END AS text,
       coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN result r ON d.doc_id = r.doc_id
"""

_SHINGLES = f"""
  SELECT {{key}}, k, unnest(CASE WHEN len(ws) >= k
         THEN list_distinct(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')))
         ELSE [] END) AS s
"""

OP3 = f"""
WITH items AS (
  SELECT item_id, ws, least(len(ws), 5) AS k
  FROM (SELECT item_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM benchmark) WHERE len(ws) > 0
), item_shingles AS ({_SHINGLES.format(key='item_id')} FROM items
), sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id
), docs AS (
  SELECT doc_id, ws, k FROM (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents), 
    (SELECT DISTINCT k FROM items)
), doc_shingles AS ({_SHINGLES.format(key='doc_id')} FROM docs
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared FROM shared JOIN sizes USING (item_id)
WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""

OP6 = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs
), runs AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM docs WHERE len(ws) >= 8)
), again AS (
  SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, d.source, len(d.ws) AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l.ls) - len(list_distinct(l.ls)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM docs d JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM failed GROUP BY source
), moments AS (
  SELECT sum(n) AS docs, count(*) AS hosts, sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS sq FROM hosts
), prior AS (
  SELECT m, CASE WHEN (sq - m * m - m * (1 - m) * hosts / docs) * 1000 <= m * (1 - m) THEN 1000.0
                 ELSE greatest(m * (1 - m) / (sq - m * m - m * (1 - m) * hosts / docs) - 1, 1.0) END AS w FROM moments
), verdicts AS (
  SELECT source, r - 1.645::DOUBLE * sqrt(r * (1 - r) / (w + n + 1)) > 0.5 AS bad
  FROM (SELECT source, n, w, (m * w + f) / (w + n) AS r FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""

# States: 0 nothing yet, 1 after the system message, 2 after a user's, 3 after an assistant's. Two inserts in
# one gap never pay: the state after them allows no more than the state before.
OP12 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(b))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c // 256, crcs[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM numbered
), faults AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate,
         body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated
  FROM judged
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, ''::VARCHAR AS said FROM faults
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT b.conv_id, f.i,
           CASE e.edit WHEN 'D' THEN b.q WHEN 'K' THEN CASE f.role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
                       ELSE CASE b.q WHEN 2 THEN 3 ELSE 2 END END AS q,
           b.cost + CASE e.edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN f.truncated AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost,
           b.audit || e.edit AS audit,
           b.said || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
                     ELSE CASE b.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) END AS said
    FROM (
      SELECT conv_id, i, CASE WHEN ins THEN CASE q WHEN 2 THEN 3 ELSE 2 END ELSE q END AS q, cost + 5 * ins::INT AS cost,
             audit || CASE WHEN ins THEN 'I' ELSE '' END AS audit,
             said || CASE WHEN ins THEN CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE '' END AS said
      FROM best, (VALUES (false), (true)) g(ins)
    ) b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1, (VALUES ('D'), ('K'), ('R')) e(edit)
    WHERE e.edit = 'D' OR (NOT f.blank AND NOT f.duplicate AND (e.edit = 'R' OR (f.role[1] = 's' AND b.q = 0)
          OR (f.role[1] = 'u' AND b.q <> 2) OR (f.role[1] = 'a' AND b.q = 2)))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY conv_id
), closed AS (
  SELECT s.conv_id, cost + CASE q WHEN 2 THEN 5 ELSE 0 END AS cost, audit || CASE q WHEN 2 THEN 'I' ELSE '' END AS audit,
         said || CASE q WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END AS said
  FROM sums s JOIN best b ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = s.n AND b.q <> 1
), ends AS (
  SELECT * FROM closed QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(left(said, length(said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLES = {"op1_line_dedup": OP1, "op3_decontamination": OP3, "op6_quality_rules": OP6, "op12_conversation_repair": OP12}
