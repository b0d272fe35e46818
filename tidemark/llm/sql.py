"""SQL for the operators that SQL can express, over the tables as the driver registers them."""

_GAP = r"\x{9}-\x{d}\x{1c}-\x{20}"
_UNSPACED = r"\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}"

#: Maximal spans of words made of runs of 50 words that stand in two places; of equal texts the one with the least id is searched.
PASSAGES = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[{_UNSPACED}]|[^{_GAP}{_UNSPACED}]+') AS ws FROM d),
long AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY text) AS lead, count(*) OVER (PARTITION BY text) AS copies FROM w WHERE len(ws) >= 50),
places AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS pos FROM long WHERE doc_id = lead)),
runs AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS s, CAST(len(ws) AS BIGINT) AS e, doc_id = lead AS keep FROM long WHERE copies > 1
  UNION ALL
  SELECT doc_id, pos, pos + 50, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) = 1 FROM places QUALIFY count(*) OVER (PARTITION BY h) > 1),
marked AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id, keep ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM runs),
numbered AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id, keep ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(e) AS INTEGER) AS end_word, keep FROM numbered GROUP BY doc_id, keep, k
"""

#: Benchmark passages; scripts without spaces, compatibility forms and decomposed letters, which the tables don't have, are left to tests.
CONTAMINATION = """
WITH texts AS (
  SELECT row_number() OVER () AS r, 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT row_number() OVER (), 'i', item_id, text FROM benchmark WHERE text IS NOT NULL),
chars AS (SELECT kind, r, id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM texts),
letters AS (SELECT *, i - row_number() OVER (PARTITION BY kind, r ORDER BY i) AS run FROM chars WHERE regexp_matches(c, '[\\p{L}\\p{N}\\p{M}]')),
words AS (SELECT kind, r, id, min(i) AS s, max(i) + 1 AS e, lower(string_agg(c, '' ORDER BY i)) AS w FROM letters GROUP BY kind, r, id, run),
lists AS (SELECT kind, r, id, list(w ORDER BY s) AS ws, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM words GROUP BY kind, r, id),
items AS (SELECT id, ws, least(8, len(ws)) AS size, len(ws) < 4 AS whole FROM lists WHERE kind = 'i'),
patterns AS (SELECT DISTINCT id, size, whole, array_to_string(ws[k + 1 : k + size], ' ') AS pattern FROM (SELECT *, unnest(range(len(ws) - size + 1)) AS k FROM items)),
sizes AS (SELECT DISTINCT size FROM items),
runs AS (SELECT r, id, size, len(ws) = size AS whole, ss[k + 1] AS s, es[k + size] AS e, array_to_string(ws[k + 1 : k + size], ' ') AS pattern
  FROM (SELECT *, unnest(range(len(ws) - size + 1)) AS k FROM lists, sizes WHERE kind = 'd' AND len(ws) >= size)),
hits AS (SELECT runs.r, runs.id AS doc_id, patterns.id AS item_id, s, e FROM runs JOIN patterns ON runs.pattern = patterns.pattern AND runs.size = patterns.size AND (runs.whole OR NOT patterns.whole)),
marked AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY r, item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM hits),
numbered AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY r, item_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT doc_id, item_id, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end" FROM numbered GROUP BY r, doc_id, item_id, k
"""
