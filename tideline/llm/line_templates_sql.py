"""The line-template rules in SQL, without keys."""

from .line_templates import AGREEMENT, BLANK, DEPTH, FIELD, MIN_DOCUMENTS, MIN_TOKENS, WORD


def line_template_ctes(source: str) -> str:
    """CTEs over a table ``source`` (doc_id, text); ``t_texts`` has doc_id, text and n_dropped."""
    return rf"""
t_docs AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS said FROM {source}),
t_lines AS MATERIALIZED (
  SELECT doc_id, line - 1 AS line, parts, len(parts) AS n, parts[1:{DEPTH}] AS lead
  FROM (SELECT doc_id, line, list_filter(regexp_split_to_array(regexp_replace(said[line], '{WORD}', '{FIELD}', 'g'), '{BLANK}'), lambda x: x <> '') AS parts
        FROM t_docs, range(1, len(said) + 1) AS r(line))
  WHERE len(parts) > 0
),
t_mixed AS (
  SELECT n, lead, count(*) AS lines FROM (SELECT DISTINCT n, lead, parts FROM t_lines WHERE n >= {MIN_TOKENS}) GROUP BY n, lead HAVING count(*) > 1
),
t_different AS MATERIALIZED (SELECT DISTINCT l.n, l.lead, l.parts, m.lines FROM t_lines l JOIN t_mixed m USING (n, lead)),
t_counted AS (SELECT n, lead, lines, spot, parts[spot] AS token, count(*) AS c FROM t_different, range({DEPTH} + 1, n + 1) AS r(spot) GROUP BY ALL),
t_best AS (
  SELECT n, lead, lines, spot, token, c FROM t_counted
  QUALIFY row_number() OVER (PARTITION BY n, lead, spot ORDER BY c DESC, token DESC) = 1
),
t_const AS (SELECT n, lead, spot, token FROM t_best WHERE 2 * c >= lines AND c >= 2),
t_general AS (
  SELECT d.n, d.lead, d.parts FROM t_different d JOIN t_const k ON d.n = k.n AND d.lead = k.lead AND d.parts[k.spot] = k.token
  GROUP BY d.n, d.lead, d.parts HAVING count(*) >= {AGREEMENT} * (d.n - {DEPTH})
),
t_keyed AS MATERIALIZED (
  SELECT l.doc_id, l.line, l.n, l.lead, CASE WHEN g.parts IS NULL THEN l.parts[{DEPTH} + 1 :] END AS rest, g.parts IS NOT NULL AS general
  FROM t_lines l LEFT JOIN t_general g ON l.n = g.n AND l.lead = g.lead AND l.parts = g.parts
),
t_marked AS (
  SELECT doc_id, line, row_number() OVER w AS r, min(doc_id) OVER p AS low, max(doc_id) OVER p AS high
  FROM t_keyed WINDOW p AS (PARTITION BY n, lead, rest, general), w AS (PARTITION BY n, lead, rest, general ORDER BY doc_id, line)
),
t_drops AS (SELECT doc_id, list(line) AS drops FROM t_marked WHERE r > 1 AND low <> high GROUP BY doc_id),
t_texts AS (
  SELECT d.doc_id, coalesce(len(x.drops), 0)::INTEGER AS n_dropped,
         CASE WHEN x.drops IS NULL THEN d.text
              ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(said)), lambda i: NOT list_contains(x.drops, i)), lambda i: said[i + 1]), chr(10)), '') END AS text
  FROM t_docs d LEFT JOIN t_drops x ON d.doc_id = x.doc_id
)"""


assert MIN_DOCUMENTS == 2  # the SQL compares the least and the greatest id

LINE_SQL = f"WITH {line_template_ctes('documents')} SELECT doc_id, n_dropped, text FROM t_texts"
