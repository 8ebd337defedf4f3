"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from flowlens.llm.licenses import TEMPLATES, THRESHOLD_PERCENT

_SPACE = r"[\x20\x09-\x0D]"
_FILLED = r"[^\x20\x09-\x0D]"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), sides AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, sides.y FROM reach JOIN sides ON reach.r = sides.x
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""

EXACT_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

LINE_WINDOWS = rf"""
WITH l AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), f AS (
  SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{_FILLED}')) AS f FROM l
), t AS (
  SELECT *, list_transform(f, lambda i: regexp_replace(l[i], '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS t FROM f
), w AS (
  SELECT doc_id, unnest(range(1, len(f) - 1)) AS k, t FROM t
), ranked AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(t[k:k + 2], chr(10)) ORDER BY doc_id, k) AS rn FROM w
), gone AS (
  SELECT doc_id, list_distinct(flatten(list([k, k + 1, k + 2]))) AS g FROM ranked WHERE rn > 1 GROUP BY doc_id
)
SELECT t.doc_id,
  CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(
    list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(list_transform(g, lambda k: f[k]), i)), lambda i: l[i]), chr(10)) END AS text,
  coalesce(len(g), 0) AS n_removed_lines
FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id
"""

_NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

LEXICAL_RANKING = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^{_NO_TERM}]+') AS w FROM documents
), l AS (
  SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM l
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^{_NO_TERM}]+')) AS t FROM benchmark
), tf AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t
), weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, totals GROUP BY t
), part AS (
  SELECT tf.r, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS part
  FROM tf JOIN weight ON tf.t = weight.t JOIN l ON tf.r = l.r, totals
), scored AS (
  SELECT item_id, r, CAST(sum(part) AS BIGINT) AS score FROM i JOIN part ON i.t = part.t GROUP BY item_id, r
), ranked AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored JOIN l ON scored.r = l.r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _licenses() -> str:
    known = ",\n  ".join(
        "({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES)
    )
    bigrams = (
        "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"
    )
    split = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return rf"""
WITH known(i, license, words) AS (VALUES
  {known}
), t AS (
  SELECT i, license, {bigrams} AS b FROM (SELECT i, license, {split.format('words')} AS w FROM known)
), u AS (
  SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)) || string_split_regex(text, '\n{_SPACE}*\n') || [text])) AS u
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT doc_id, {bigrams} AS b FROM (SELECT doc_id, {split.format('u')} AS w FROM u)
), hits AS (
  SELECT doc_id, i, license, len(list_intersect(b.b, t.b)) AS shared, len(b.b) AS unit_size, len(t.b) AS template_size
  FROM b JOIN t ON len(b.b) > 0 AND len(b.b) * {THRESHOLD_PERCENT} <= len(t.b) * {200 - THRESHOLD_PERCENT}
    AND len(t.b) * {THRESHOLD_PERCENT} <= len(b.b) * {200 - THRESHOLD_PERCENT}
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY 2 * shared / (unit_size + template_size) DESC, shared DESC, i,
    unit_size DESC, template_size DESC) AS rn
  FROM hits WHERE 200 * shared >= {THRESHOLD_PERCENT} * (unit_size + template_size)
)
SELECT d.doc_id, license, CAST(shared AS INTEGER) AS shared, CAST(unit_size AS INTEGER) AS unit_size,
  CAST(template_size AS INTEGER) AS template_size
FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id AND rn = 1
"""


LICENSES = _licenses()
