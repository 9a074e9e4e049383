"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(text, '[\\<>\[]', '..', 'g')) + length(regexp_replace(role, '[\\<>\[]', '..', 'g')) + 11 AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP8 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT row_no, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM texts),
win AS (
  SELECT row_no, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3),
tri AS (
  SELECT row_no, i, count(*) OVER (PARTITION BY row_no, words[i], words[i + 1], words[i + 2]) AS c FROM win),
rep AS (
  SELECT row_no, count(DISTINCT p)::BIGINT AS n FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c >= 2) GROUP BY row_no),
counts AS (
  SELECT s.row_no, doc_id, host, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM split s LEFT JOIN rep USING (row_no)),
fails AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base,
    n_symbols / greatest(n_words, 1) > 0.3 OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR word_chars / greatest(n_words, 1) > 20 AS hard,
    n_symbols / greatest(n_words, 1) > 0.15 OR n_dup_lines / greatest(n_lines, 1) > 0.3 OR word_chars / greatest(n_words, 1) > 14 AS strict
  FROM counts),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (base OR hard) AS failed FROM fails GROUP BY host),
totals AS (
  SELECT sum(failed) / sum(n) AS m, sum(n * (failed / n) * (failed / n)) AS s2, sum(n) AS total, count(*) AS k FROM hosts),
prior AS (
  SELECT m, greatest(2.0, least(1e4, m * (1 - m) / greatest(s2 / total - m * m - m * (1 - m) * k / total, 1e-6) - 1)) AS strength FROM totals),
post AS (
  SELECT host, failed + m * strength AS a, n - failed + (1 - m) * strength AS b FROM hosts, prior),
rates AS (
  SELECT host, a / (a + b) AS rate FROM post)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed,
  NOT base AND r.rate * (1 + CASE WHEN hard THEN 40.0 WHEN strict THEN 3.0 ELSE 0.2 END) < 1 AS kept
FROM fails f JOIN rates r ON f.host IS NOT DISTINCT FROM r.host
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item, w FROM (
    SELECT item, unnest([ws[i:i + 9] FOR i IN range(1, len(ws) - 8)]) AS w FROM items WHERE len(ws) >= 10
    UNION ALL SELECT item, ws FROM items WHERE len(ws) BETWEEN 1 AND 9)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
sizes AS (
  SELECT DISTINCT len(w) AS n FROM wins),
places AS (
  SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM docs JOIN sizes ON len(ws) >= n),
hits AS (
  SELECT r, i, n, item FROM (SELECT r, i, n, ws[i:i + n - 1] AS w FROM places) p JOIN wins USING (w)),
marks AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) m GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) d GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marks USING (r) LEFT JOIN found USING (r)
"""

OP12 = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, ws[i:i + k - 1] AS g, k FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws)),
f AS (
  SELECT lang, g, k, count(*) AS f FROM grams GROUP BY ALL),
n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
cand AS (
  SELECT lang, g, k, f AS a FROM f WHERE k >= 2 AND f >= 100),
cuts AS (
  SELECT lang, g, k, a, unnest(range(1, k)) AS c FROM cand),
scores AS (
  SELECT cuts.lang, cuts.g, a, c, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:c] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[c + 1:cuts.k] JOIN n ON n.lang = cuts.lang),
best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
covered AS (
  SELECT DISTINCT s.lang, s.g FROM (SELECT lang, a, k, g, unnest(range(1, k)) AS m FROM cand) x, (SELECT unnest(range(1, 5)) AS i) o, cand s
  WHERE m >= 2 AND i + m - 1 <= x.k AND s.lang = x.lang AND s.g = x.g[i:i + m - 1] AND 100 * x.a >= 100 * s.a),
said AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best WHERE NOT EXISTS (SELECT 1 FROM covered WHERE covered.lang = best.lang AND covered.g = best.g))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM said QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4, "op8_quality_rules": OP8, "op11_decontamination": OP11, "op12_collocations": OP12}
