"""SQL for the columns that SQL can express of operators whose models it can't."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: Words, symbols, repeated lines and repeated windows of every text, and the base rule.
RULE_COUNTS = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d
), x AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), y AS (
  SELECT r, i, word || ' ' || lead(word, 1) OVER q || ' ' || lead(word, 2) OVER q || ' ' || lead(word, 3) OVER q || ' ' || lead(word, 4) OVER q AS gram
  FROM x WINDOW q AS (PARTITION BY r ORDER BY i)
), z AS (
  SELECT r, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS hit FROM y
), k AS (
  SELECT r, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM z
), repeated AS (
  SELECT r, count(*) FILTER (WHERE covered) AS n FROM k GROUP BY r
), l AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line FROM d
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY r
), c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""

#: Sizes and targets: the level at which sources' shares by weight, each up to twice its size, add up to 150 %.
MIX_TARGETS = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER q AS k, coalesce(sum(2.0 * source_size) OVER p, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER p, 0)::DOUBLE AS gone,
    (sum(source_size) OVER () * 1.5)::DOUBLE AS total, (sum(weight) OVER ())::DOUBLE AS weights
  FROM s WINDOW q AS (ORDER BY source_size / weight, source NULLS LAST), p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((total - capped) / (weights - gone), k) AS level FROM o WHERE (total - capped) / (weights - gone) * weight <= 2.0 * source_size
), t AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(level, 0) * weight) AS target FROM s, level
)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

#: crc32 of the id's digits: eight shifts for each byte.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
)

#: The word base of language-model scores.
WORD_BASE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC} % 7 = 2, false) AS held_out,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents
), x AS (
  SELECT r, held_out, unnest(ws) AS token FROM d UNION ALL SELECT r, held_out, NULL FROM d
), c AS (
  SELECT token, count(*) AS c FROM x WHERE NOT held_out GROUP BY token
), n AS (
  SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS distinct_ FROM c
), s AS (
  SELECT r, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, sum(log10((coalesce(c, 0) + 1) / (total + distinct_ + 1))) AS base
  FROM x LEFT JOIN c ON x.token IS NOT DISTINCT FROM c.token, n GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, round(base, 3) AS base_score FROM d JOIN s USING (r), n
"""
