"""What the operators' queries return, as DuckDB SQL over the tables."""

from __future__ import annotations

from . import quality, secrets

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (SELECT doc_id, j, substr(h, 2 * j + 1, 300) AS piece FROM d, unnest(range(0, length(h) // 2, 100)) AS u(j)
), w AS (
  SELECT doc_id, j + o AS i, substr(piece, 2 * o + 1, 100) AS win FROM p, unnest(range(0, least(100, length(piece) // 2 - 49))) AS u(o) WHERE length(piece) >= 100
), f AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING count(DISTINCT doc_id) > 1
), s AS (SELECT w.doc_id, w.i FROM w JOIN f USING (win) WHERE w.doc_id > f.least
), c AS (SELECT DISTINCT doc_id, i + k AS b FROM s, unnest(range(0, 50)) AS u(k)
), r AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (b - coalesce(before, -2) > 1) AS n_spans
  FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM c) GROUP BY doc_id
), k AS (
  SELECT doc_id, string_agg(substr(piece, 2 * (b - j) + 1, 2), '' ORDER BY b) AS left_
  FROM (SELECT p.doc_id, piece, j, j + o AS b FROM p JOIN r USING (doc_id), unnest(range(0, least(100, length(piece) // 2))) AS u(o)) AS a
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = a.doc_id AND c.b = a.b) GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE coalesce(left_, '') END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS win FROM d, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20
), s AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM g) WHERE n > 1
), c AS (SELECT DISTINCT doc_id, i + k AS b FROM s, unnest(range(0, 20)) AS u(k)
), k AS (
  SELECT a.doc_id, string_agg(a.x, ' ' ORDER BY a.b) AS left_, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS b FROM d) AS a
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = a.doc_id AND c.b = a.b) GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scans(rules=secrets.RULES, n_base: int = len(secrets.BASE)) -> str:
    """Positions follow from the matches and the pieces between them, which alternate."""
    found = []
    for k, r in enumerate(rules):
        p = r.pattern + r.tail
        body = p
        if r.head:  # what follows the head, in a group of its own
            p = body = f"(?:{r.head})({r.pattern[len(r.head):]})"
        if r.fold:
            p, body = f"(?i){p}", f"(?i){body}"
        # the least lengths in the patterns are of whole runs, so a run is matched and then measured
        p = p.replace("[A-Z0-9]{12,}", "[A-Z0-9]+").replace("[0-9a-f]{32,}", "[0-9a-f]+")
        size = f"length(regexp_extract(m, {_sql('^' + p + '$')}, {2 + r.head.count('(') - 1}))" if r.head else "length(m)"
        found.append(
            f"SELECT doc_id, {k} AS k, {_sql(r.kind)} AS kind, length(m) AS len, {size} AS n, CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(f, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS s "
            f"FROM (SELECT doc_id, p, f, i, f[i] AS m FROM (SELECT doc_id, string_split_regex(text, {_sql(p)}) AS p, regexp_extract_all(text, {_sql(p)}) AS f FROM documents WHERE text <> ''), unnest(range(1, len(f) + 1)) AS u(i)) WHERE n >= {r.min_chars}"
        )
    say = "kind || ':' || s || ':' || (s + len)"
    counts = ", ".join(f"count(f.k) FILTER (f.k = {k}) AS n_{r.kind}" for k, r in enumerate(rules[:n_base]))
    return (
        f"WITH f AS ({' UNION ALL '.join(found)}) SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({say}, ',' ORDER BY s, k) FILTER (f.k < {n_base}), '')) AS base_sha256, "
        f"coalesce(string_agg({say}, ',' ORDER BY s, k), '') AS spans, count(f.k) AS n_spans FROM documents AS d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"
    )


def _holds(r: quality.Threshold) -> str:
    out = " AND ".join([f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None))
    return f"({out} OR {_holds(r.unless)})" if r.unless else f"({out})"


def quality_rules(rules=quality.TABLE) -> str:
    gone = lambda runs: f"length(t) - length(regexp_replace(t, {_sql(runs)}, '', 'g'))"
    stops = ", ".join(map(_sql, dict.fromkeys(quality.STOP_WORDS)))
    ratio = lambda a, b: f"CAST({a} AS DOUBLE) / greatest({b}, 1)"
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM a
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS often FROM l, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) > 2
), r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, unnest(range(0, 3)) AS u(k) WHERE often > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({gone(quality.SYMBOLS)} AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stop_words, {gone(quality.UPPER)} AS upper_, {gone(quality.MARKS)} AS marks, {gone('!+')} AS bangs
  FROM l LEFT JOIN r USING (doc_id)
), q AS (
  SELECT *, {ratio('word_chars', 'n_words')} AS mean_word_chars, {ratio('n_symbols', 'n_words')} AS symbol_ratio, {ratio('stop_words', 'n_words')} AS stop_word_ratio, {ratio('marks', 'word_chars')} AS mark_ratio,
         {ratio('upper_', 'word_chars - marks')} AS upper_ratio, {ratio('bangs', 'n_words')} AS bang_ratio, {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('n_repeat_words', 'n_words')} AS repeat_word_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(map(_holds, rules))} AS kept FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": SUFFIX_DEDUP, "op2_substring_dedup": SUBSTRING_DEDUP, "op6_ngram_jaccard_join": JACCARD,
        "op8_secret_scans": secret_scans(), "op9_quality_rules": quality_rules(),
    }
