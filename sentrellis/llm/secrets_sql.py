"""The secret scan as DuckDB SQL: patterns, samples, training and scoring, for holding the query against it."""

from __future__ import annotations

from . import secrets


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The engine folds case beyond ASCII, so every letter is written out.
ASSIGN = "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _blanked(of: str, pattern: str, keep: str = "true") -> str:
    """Texts of ``of`` with spaces for their matches."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE WHEN {keep} THEN repeat(' ', length(m[i])) ELSE m[i] END, '')), '') AS t
  FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS g FROM {of})"""


def _matches(pattern: str, kind: int, keep: str = "true", of: str = "d") -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS kind, m[i] AS match,
       CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS start
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS g FROM {of}))
  WHERE {keep}"""


def query() -> str:
    parts = ", ".join(map(_quoted, secrets.PARTS))
    pick = [f"p[CAST('0x' || substr(h, {1 + 6 * k}, 6) AS BIGINT) % {len(secrets.PARTS)} + 1]" for k in range(5)]
    title = lambda w: f"(upper({w}[1]) || {w}[2:])"
    run = secrets.RUN.removesuffix("+")
    long_enough = f"length(regexp_extract(m[i], {_quoted(ASSIGN)}, 1)) >= {secrets.ASSIGN_VALUE}"
    weight = f"({secrets.CORPUS_WEIGHT} * coalesce(fw.n, 0) / (coalesce(fw.n, 0) + {secrets.CORPUS_PAIRS}))"
    s, names = secrets.SMOOTHING, ", ".join(map(_quoted, secrets.KINDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (
  SELECT h, to_base64(unhex(h)) AS b64, [{parts}] AS p FROM (SELECT sha256(CAST(i AS VARCHAR)) AS h FROM range({secrets.SAMPLES}) r(i))
), w AS (
  SELECT h, b64, {", ".join(f"{x} AS w{k}" for k, x in enumerate(pick))} FROM b
), samples AS (
  SELECT 1 AS label, unnest([b64, translate(b64, '+/=', '-_'), h, upper(translate(b64, '+/=', 'XYZ'))]) AS text FROM w
  UNION ALL SELECT 0, unnest([w0 || '_' || w1 || '_' || w2 || '_' || w3, w0 || {title("w1")} || {title("w2")} || {title("w3")}, w0 || '-' || w1 || '-' || w2 || '-' || w3 || '-' || w4,
    upper(w0 || '_' || w1 || '_' || w2), w0 || w1 || w2 || w3 || w4, w0 || '/' || w1 || '/' || w2 || '/' || w3 || '/' || w4,
    z[31:34] || '-' || z[35:36] || '-' || z[37:38], w0 || '_' || z[39:40] || '-' || w1 || '_' || z[41:44], z[45:47] || '-' || z[48:50] || '-' || z[51:54], z[31:46]])
  FROM (SELECT *, translate(h, 'abcdef', '012345') AS z FROM w)
), c AS (
  SELECT label, substr(text, i, 1) AS a, substr(text, i + 1, 1) AS z, count(*) AS n FROM (SELECT label, text, unnest(range(1, length(text))) AS i FROM samples) GROUP BY ALL
), f AS (
  SELECT label, a, sum(n) AS n FROM c GROUP BY ALL
), base AS (
  {_matches(ASSIGN, 0, long_enough)}
  UNION ALL {_matches(secrets.ACCESS, 1)}
  UNION ALL {_matches(secrets.HEX, 2)}
), free1 AS (
  {_blanked("d", ASSIGN, long_enough)}
), free2 AS (
  {_blanked("free1", secrets.ACCESS)}
), free AS (
  {_blanked("free2", secrets.HEX)}
), words AS (
  SELECT unnest(list_filter(regexp_extract_all(t, '{secrets.TOKEN}+', 0), lambda x: regexp_full_match(x, '[A-Za-z]{{2,}}'))) AS word FROM free
), cw AS (
  SELECT substr(word, i, 1) AS a, substr(word, i + 1, 1) AS z, sum(k) AS n
  FROM (SELECT word, k, unnest(range(1, length(word))) AS i FROM (SELECT word, count(*) AS k FROM words GROUP BY word)) GROUP BY ALL
), fw AS (
  SELECT a, sum(n) AS n FROM cw GROUP BY ALL
), runs AS (
  {_matches(run, 3, of="free")}
), scored AS (
  SELECT r.doc_id, r.kind, r.match, r.start,
         sum(round(ln((coalesce(c1.n, 0) + {s}) / (coalesce(f1.n, 0) + {96 * s}))
           - ln((1 - {weight}) * ((coalesce(c0.n, 0) + {s}) / (coalesce(f0.n, 0) + {96 * s})) + {weight} * coalesce(cw.n, 0) / greatest(coalesce(fw.n, 0), 1)), 6)) AS ratio
  FROM (SELECT *, unnest(range(1, length(match))) AS i FROM runs) r
  LEFT JOIN c c1 ON c1.label = 1 AND c1.a = substr(match, i, 1) AND c1.z = substr(match, i + 1, 1)
  LEFT JOIN c c0 ON c0.label = 0 AND c0.a = substr(match, i, 1) AND c0.z = substr(match, i + 1, 1)
  LEFT JOIN f f1 ON f1.label = 1 AND f1.a = substr(match, i, 1)
  LEFT JOIN f f0 ON f0.label = 0 AND f0.a = substr(match, i, 1)
  LEFT JOIN cw ON cw.a = substr(match, i, 1) AND cw.z = substr(match, i + 1, 1)
  LEFT JOIN fw ON fw.a = substr(match, i, 1)
  GROUP BY r.doc_id, r.kind, r.match, r.start
), added AS (
  SELECT doc_id, kind, match, start FROM scored s WHERE ratio > greatest({secrets.RATIO} * (length(match) - 1), {secrets.TOTAL})
  AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = s.doc_id AND x.start < s.start + length(s.match) AND s.start < x.start + length(x.match))
), spans AS (
  SELECT doc_id, kind, start, [{names}][kind + 1] || ':' || start || ':' || (start + length(match)) AS s FROM (SELECT * FROM base UNION ALL SELECT doc_id, kind, match, start FROM added)
)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id
"""
