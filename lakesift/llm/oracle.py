"""DuckDB SQL of the registered queries; patterns and limits are written out
here again on purpose, so that they check those of the operators."""

from __future__ import annotations

OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(g) AS g FROM (
    SELECT doc_id, unnest([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) AS g FROM d WHERE len(w) >= 4
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
tok AS (
  SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS pos
  FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)),
words AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM tok GROUP BY rid),
win AS (
  SELECT rid, pos, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c
  FROM tok WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (
  SELECT rid, pos FROM (
    SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win WHERE c IS NOT NULL)
  WHERE n > 1),
cover AS (
  SELECT rid, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
every AS (
  SELECT rid, l, pos, regexp_matches(l, '[^\x20\x09-\x0D]') AS has_word,
    regexp_matches(l, '[.!?…‼⁇⁈⁉‽。！？｡．﹒﹖﹗؟۔।॥։።፧፨။៕៖᠃᠉།༎෴]["''”’»)\]]*([ \t\r]|$)|[\x{0E01}-\x{0EDF}]') AS has_end
  FROM (SELECT rid, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d))),
line AS (
  SELECT rid, l, bool_or(has_end) OVER (PARTITION BY rid, paragraph) AS ended
  FROM (SELECT *, count(*) FILTER (NOT has_word) OVER (PARTITION BY rid ORDER BY pos) AS paragraph FROM every)
  WHERE has_word),
sized AS (
  SELECT rid, l, ended, length(l) AS chars,
    length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS symbols,
    length(l) - length(regexp_replace(l, '\p{Lu}', '', 'g')) AS upper_n,
    length(l) - length(regexp_replace(l, '\p{Ll}', '', 'g')) AS lower_n
  FROM line),
judged AS (
  SELECT rid, l, chars,
    (chars < 25 AND NOT ended)
    OR (chars <= 160 AND regexp_matches(l, '(?i)(javascript|cookie|lorem ipsum|all rights reserved|terms of (use|service)|privacy policy|sign in|log in|subscribe|click here|read more|share this|skip to content|back to top)'))
    OR (regexp_matches(l, '[#*$%&|<>]| [»•·] |\p{Lu}[^\p{Ll}]{0,4}\p{Lu}')
        AND (len(regexp_extract_all(l, ' [|»•·>] ')) >= 3 OR symbols * 100 > chars * 10
             OR upper_n * 100 > (upper_n + lower_n) * 60)) AS bad
  FROM sized),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup,
    count(*) FILTER (bad) AS removed, sum(chars) AS all_chars, coalesce(sum(chars) FILTER (bad), 0) AS lost
  FROM judged GROUP BY rid),
f AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(removed, 0)::BIGINT AS n_removed_lines,
    coalesce(lost, 0)::BIGINT AS n_lost_chars, coalesce(all_chars, 0) AS all_chars
  FROM d LEFT JOIN words USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines, n_lost_chars,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_lost_chars * 100 > all_chars * 30 AS kept
FROM f
"""

OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    sha256(concat('0:', coalesce(doc_id::VARCHAR, ''), ':', sha256(coalesce(text, '')))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT source, words, i, [3.0::DOUBLE, 1.0, 2.0][(i - 1) % 3 + 1] AS weight, 1.5::DOUBLE * sum(words) OVER () AS total FROM s),
o AS (
  SELECT *, total - coalesce(sum(2.0 * words) OVER b, 0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight
  FROM w WINDOW b AS (ORDER BY words / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 2 * words * left_weight <= left_words * weight AS is_full FROM o),
z AS (
  SELECT coalesce(sum(2.0 * words) FILTER (is_full), 0) AS spent, coalesce(sum(weight) FILTER (is_full), 0) AS used FROM f),
t AS (
  SELECT source, words, CASE WHEN is_full THEN 2.0 * words
    ELSE (total - spent) * weight / ((SELECT sum(weight) FROM w) - used) END::DOUBLE AS target FROM f, z),
r AS (
  SELECT source, words, target, CASE WHEN words > 0 THEN floor(target + 0.5)::BIGINT // words ELSE 0 END AS epochs,
    CASE WHEN words > 0 THEN floor(target + 0.5)::BIGINT % words ELSE 0 END AS rest FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, size, words AS source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v))::BIGINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v))::BIGINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(f), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.s = a.source AND z.t = b.source GROUP BY ALL),
terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))
  FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) <= 50)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r
"""

OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(g) AS g FROM (
    SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM d WHERE len(w) >= 2
    UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""

OP13 = r"""
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum([a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)])::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": OP1,
    "op3_quality_rules": OP3,
    "op6_exact_dedup": OP6,
    "op8_source_mix": OP8,
    "op11_divergence_audit": OP11,
    "op12_setsketch_dedup": OP12,
    "op13_hard_negatives": OP13,
}
