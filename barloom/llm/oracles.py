"""The registered queries that SQL can express, for DuckDB."""

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE
t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents),
n AS (SELECT row_number() OVER () AS id, x, min(doc_id) AS least, count(*) AS copies FROM t GROUP BY x),
w AS (SELECT id, regexp_extract_all(x, '{WORD}') AS w FROM n),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pair AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
half AS (SELECT a, b FROM pair JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT id, id AS other FROM size UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other),
class AS (SELECT reach.id, min(n.least) AS class_id FROM reach JOIN n ON n.id = reach.other GROUP BY reach.id),
degree AS (SELECT a AS id, count(*) AS links FROM link GROUP BY a)
SELECT t.doc_id, coalesce(class.class_id, t.doc_id) AS class_id, coalesce(links, 0) AS n_links,
       CASE WHEN class.id IS NULL THEN 1 ELSE copies END AS n_copies
FROM t JOIN n USING (x) LEFT JOIN class ON class.id = n.id LEFT JOIN degree ON degree.id = n.id
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '{WORD}') AS w FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY k),
split AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
line AS (SELECT k, line, len(lw) AS n, regexp_replace(lower(array_to_string(lw, ' ')), '\d+', '0', 'g') AS norm
         FROM (SELECT k, line, regexp_extract_all(line, '{WORD}') AS lw FROM split) WHERE len(lw) > 0),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM line GROUP BY k),
one AS (SELECT min(k) AS k, source FROM d GROUP BY source, t),
host AS (SELECT source, count(*) AS docs FROM one GROUP BY source),
often AS (SELECT f.source, norm FROM (
            SELECT one.source, norm, count(DISTINCT line.k) AS n FROM line JOIN one USING (k) GROUP BY ALL) f
          JOIN host ON f.source IS NOT DISTINCT FROM host.source AND n > 20 AND n > 0.02 * docs),
gone AS (SELECT k, sum(n) AS n, count(*) AS lines FROM line JOIN d USING (k)
         JOIN often ON d.source IS NOT DISTINCT FROM often.source AND line.norm = often.norm GROUP BY k),
counts AS (
  SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         coalesce(gone.n, 0) AS removed_words, coalesce(gone.lines, 0) AS n_removed_lines
  FROM d JOIN w USING (k) LEFT JOIN cov USING (k) LEFT JOIN dup USING (k) LEFT JOIN gone USING (k)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       base_failed, NOT base_failed AND removed_words <= 0.5 * n_words AS kept,
       CAST(removed_words AS BIGINT) AS removed_words, n_removed_lines
FROM judged
"""
OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP12 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

# CRC-32 over code points below U+0100 as UTF-8, its table from the rule of its polynomial.
OP13 = r"""
WITH RECURSIVE
rule AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, _: CASE
           WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
         FROM (SELECT unnest(range(256))::UBIGINT AS i)),
run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
        FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)),
one AS (SELECT doc_id, r, count(*) AS n, string_split(doc_id || ':' || r, '') AS cs FROM run GROUP BY doc_id, r),
hash AS (SELECT doc_id, r, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(cs,
           lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))::UBIGINT[]),
           lambda c, b: xor(t[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) AS h
         FROM one, rule),
told AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2)
                ELSE r END AS word, n FROM hash),
v AS (SELECT word, sum(n)::BIGINT AS n FROM told WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
         UNION SELECT l.word, v.word, v.n FROM less l JOIN v ON l.d = v.word
         UNION SELECT v.word, l.word, l.n FROM less l JOIN v ON l.d = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min({'f': near, 'n': near_n}, {'m': -near_n, 'f': near}) AS f FROM pair GROUP BY word),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * v.n THEN f.f END AS form,
                CASE WHEN f.n >= 2 * v.n THEN f.n END AS form_n FROM v LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root FROM form
         UNION ALL SELECT path.word, form.form FROM path JOIN form ON form.word = path.root WHERE form.form IS NOT NULL),
root AS (SELECT path.word, path.root FROM path JOIN form ON form.word = path.root WHERE form.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN root USING (word)
"""

ORACLES = {"op1_ngram_jaccard_join": OP1, "op3_quality_rules": OP3, "op5_top_k": OP5, "op12_exact_copies": OP12,
           "op13_spelling_variants": OP13}
