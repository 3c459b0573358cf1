"""What the quality rules return, in DuckDB SQL, with their default parameters."""

_JS = """sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: (CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END + CASE WHEN {q}[i] > 0 THEN {q}[i] * log2({q}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END) / 2))))"""

ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
  length(text) - length(regexp_replace(text, '[!"''()+,\-./:;=?@\[\\\]^_`{{}}~]', '', 'g')) AS punctuation, list_transform(w, lambda x: lower(x)) AS ws FROM d),
c AS (SELECT *, [word_chars - capitals - digits - n_symbols - punctuation, capitals, digits, n_chars - word_chars, n_symbols, punctuation] AS classes FROM f),
z AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(ws) AS x FROM c) GROUP BY lang, x),
y AS (SELECT lang, sum(n) AS n FROM z WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n) >= 2000),
k AS (SELECT lang, x, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS place FROM z WHERE lang IS NOT NULL),
t AS (SELECT lang, list(x ORDER BY place) AS xs, list(n ORDER BY place) AS ns FROM k WHERE place <= 16 GROUP BY lang),
s AS (SELECT lang, [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6])] AS t FROM c GROUP BY lang),
e AS (SELECT [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6])] AS t FROM c),
ka AS (SELECT x, sum(n) AS n FROM z GROUP BY x ORDER BY sum(n) DESC, x LIMIT 16),
a AS (SELECT list(x ORDER BY n DESC, x) AS axs, list(n ORDER BY n DESC, x) AS ans, (SELECT sum(n) FROM z) AS an FROM ka),
p AS (SELECT CASE WHEN an >= 2000 THEN axs END AS axs, CASE WHEN an >= 2000 THEN list_append(list_transform(ans, lambda v: CAST(v AS DOUBLE) / CAST(an AS DOUBLE)), 1 - CAST(list_sum(ans) AS DOUBLE) / CAST(an AS DOUBLE)) END AS ashares FROM a),
ref AS (SELECT s.lang, list_transform(s.t, lambda v: CAST(v AS DOUBLE) / CAST(list_sum(s.t) AS DOUBLE)) AS q, t.xs, list_append(list_transform(t.ns, lambda v: CAST(v AS DOUBLE) / CAST(y.n AS DOUBLE)), 1 - CAST(list_sum(t.ns) AS DOUBLE) / CAST(y.n AS DOUBLE)) AS shares FROM s JOIN t ON s.lang = t.lang JOIN y ON s.lang = y.lang),
j AS (SELECT c.*, list_transform(c.classes, lambda v: CAST(v AS DOUBLE) / c.n_chars) AS own, coalesce(ref.q, list_transform(e.t, lambda v: CAST(v AS DOUBLE) / CAST(list_sum(e.t) AS DOUBLE))) AS q, coalesce(ref.shares, p.ashares) AS shares,
  list_transform(coalesce(ref.xs, p.axs), lambda y: CAST(len(list_filter(c.ws, lambda z: z = y)) AS DOUBLE) / c.n_words) AS seen FROM c CROSS JOIN e CROSS JOIN p LEFT JOIN ref ON c.lang = ref.lang),
h AS (SELECT *, list_append(seen, 1 - list_sum(seen)) AS mine FROM j),
m AS (SELECT h.*, CASE WHEN n_chars > 0 THEN {_JS.format(p="own", q="q")} END AS cd, CASE WHEN n_words >= 50 AND shares IS NOT NULL THEN {_JS.format(p="mine", q="shares")} END AS wd, 0.95 * sqrt((1 - shares[-1] + log2(2 / (1 + shares[-1])) + CASE WHEN shares[-1] > 0 THEN shares[-1] * log2(2 * shares[-1] / (1 + shares[-1])) ELSE 0 END) / 2) AS most FROM h),
v AS (SELECT m.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_dup_lines, 0) AS n_dup_lines FROM m LEFT JOIN r ON m.doc_id = r.doc_id LEFT JOIN l ON m.doc_id = l.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 1) <= 0.25 AND coalesce(wd <= most, TRUE) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM b
"""
