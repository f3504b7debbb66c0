"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from .secret_scan import BASE, RULES, Rule

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, sum(span) AS n_repeat_words
  FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS span FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations
  FROM d LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines > 0.5::DOUBLE * n_lines
            OR word_chars < 2.0::DOUBLE * n_words OR word_chars > 15.0::DOUBLE * n_words
            OR n_exclamations > 0.5::DOUBLE * n_words) AS kept
FROM b
"""

OP11 = """
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
         (xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(a, b)), 4294967295)) % 6)::BIGINT AS h
  FROM t
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, d, chars FROM (
    SELECT c.conv_id, 0 AS own, t.pos, t.d, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT c.conv_id, 1, t.pos, t.d, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h)
), p AS (
  SELECT conv_id, depth, chars, string_agg(d, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path, max(depth) OVER (PARTITION BY conv_id) AS length FROM r
  UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM r WHERE r.conv_id = c.conv_id), 0) FROM c
), n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM p GROUP BY path, depth
), e AS (
  SELECT n.*, u.path AS up, u.conv_id AS parent_conv_id
  FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n AS u ON u.path = p.path AND u.depth = p.depth
), k AS (
  SELECT e.*, coalesce(x.m, 0) AS n_children FROM e LEFT JOIN (SELECT up, depth - 1 AS depth, count(*) AS m FROM e WHERE up IS NOT NULL GROUP BY ALL) x ON x.up = e.path AND x.depth = e.depth
), s AS (
  SELECT a.path, a.depth, sum((k.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((k.n_convs - 1) * k.chars)::BIGINT AS saved_tokens
  FROM k JOIN p AS a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM k JOIN s USING (path, depth)
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS p, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS q,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), cut AS (
  SELECT *, coalesce(array_to_string(units[1:least(p, q)], ''), '') AS a, coalesce(array_to_string(units[least(p, q) + 1:greatest(p, q)], ''), '') AS b,
         coalesce(array_to_string(units[greatest(p, q) + 1:], ''), '') AS c
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


def _matches(rules: Sequence[Rule]) -> str:
    """SQL of (rid, kind, place, s, e): the matches of every rule, by the lengths of what lies between them."""
    parts = []
    for i, r in enumerate(rules):
        p = "'" + r.expression.replace("'", "''") + "'"
        parts.append(f"""
  SELECT rid, '{r.kind}' AS kind, {i} AS place, e - length(w) AS s, e FROM (
    SELECT rid, whole[i] AS w, value[i] AS v, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(whole[1:i], lambda x: length(x))))::BIGINT AS e
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i
          FROM (SELECT rid, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {r.group}) AS value, string_split_regex(t, {p}) AS gaps FROM d)))
  WHERE length(v) >= {r.least}""")
    return " UNION ALL ".join(parts)


OP13 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
m AS ({_matches(RULES)}
), by_row AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {len(BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM m GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_row USING (rid)
"""

ORACLE_SQL = {"op4_quality_rules": OP4, "op11_conversation_trie": OP11, "op12_fill_in_middle": OP12, "op13_secret_scan": OP13}
