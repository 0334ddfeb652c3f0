"""The SQL that the divergence audit and the quality rules are held against."""

from . import divergence, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _p(count: str, total: str) -> str:
    return f"CAST(1 + ({divergence.PARTS}::HUGEINT * ({count} + 2)) // ({total} + 2 * v) AS HUGEINT)"


F = "CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)"

OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS total FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), s AS (
  SELECT DISTINCT d.lang, d.source, coalesce(x.n, 0)::HUGEINT AS n, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS total
  FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) x USING (lang, source) LEFT JOIN l ON d.lang = l.lang
), z AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_p("coalesce(c.n, 0)", "s.n")} AS p, {_p("k.total", "s.total")} AS q
  FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT lang, source, item, sum({F}) AS value
    FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM z a JOIN z b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source)
    GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, {F} FROM z WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""

WORD = r"[^\x20\x09-\x0D]+"
_BIT = {name: 1 << k for k, name in enumerate(rules.RULES)}

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times
  FROM (SELECT r, i, ws[i:i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))
), c AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE times > 1) GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower,
         len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letter_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN c USING (r)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (CASE WHEN n_words < 50 THEN {_BIT["few_words"]} ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN {_BIT["repeated_windows"]} ELSE 0 END)
    + (CASE WHEN 10 * word_chars < 20 * n_words THEN {_BIT["short_words"]} ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN {_BIT["long_words"]} ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN {_BIT["symbols"]} ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN {_BIT["repeated_lines"]} ELSE 0 END)
    + (CASE WHEN n_upper > n_lower THEN {_BIT["capitals"]} ELSE 0 END)
    + (CASE WHEN 10 * n_letter_words < 8 * n_words THEN {_BIT["few_letters"]} ELSE 0 END)
    + (CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN {_BIT["bullets"]} ELSE 0 END)
    + (CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN {_BIT["ellipses"]} ELSE 0 END) AS failed
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""
