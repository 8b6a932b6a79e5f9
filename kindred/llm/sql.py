"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

#: Words of ``t.text`` in DuckDB: runs of characters other than space and 0x09-0x0D.
WORDS = r"regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')"

#: Per-document rule counts of the table ``docs``, as ``counted``.
COUNTED = rf"""
texts AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM docs),
worded AS (SELECT t.*, {WORDS} AS w FROM texts t),
grams AS (
  SELECT rid, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] || chr(10) || w[i+3] || chr(10) || w[i+4] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM worded WHERE len(w) > 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
counted0 AS (
  SELECT t.rid, t.doc_id, t.source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM worded t LEFT JOIN covered c USING (rid)),
counted AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted0)"""

#: Hosts that the rules reject, as ``rejected``.
REJECTED = """
hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS base,
    sum((10 * n_symbols > word_chars)::INT)::DOUBLE AS symbols,
    sum((n_dup_lines >= 3 AND 5 * n_dup_lines > n_words)::INT)::DOUBLE AS lines
  FROM counted GROUP BY source),
tall AS (SELECT source, n, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base, symbols, lines]) AS f FROM hosts),
moments AS (SELECT rule, sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1.0::DOUBLE / n) AS inv FROM tall GROUP BY rule),
priors AS (SELECT rule, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-12) - 1, 1), 1e6) AS s FROM moments),
rejected AS (
  SELECT DISTINCT source FROM tall JOIN priors USING (rule)
  WHERE (f + m * s) / (n + s) > 0.5 AND n >= 20 AND source IS NOT NULL)"""

OP9 = f"""
WITH docs AS (SELECT * FROM documents), {COUNTED}, {REJECTED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  source IS NOT NULL AND source IN (SELECT source FROM rejected) AS host_rejected,
  NOT base_failed AND NOT (source IS NOT NULL AND source IN (SELECT source FROM rejected)) AS kept
FROM counted"""


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": OP9}
