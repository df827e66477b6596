"""SQL that the results of queries are checked against."""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
p AS (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT *, trim(piece, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM p),
w AS (SELECT r, unnest(string_split_regex(text, '[\x20\x09-\x0D]')) AS word FROM d),
o AS (SELECT r, max(struct_pack(n := length(word), w := word)).w AS origin FROM w GROUP BY r),
b AS (SELECT line FROM l JOIN o USING (r) WHERE length(line) >= 12 GROUP BY line
  HAVING count(DISTINCT source) >= 5 AND count(DISTINCT origin) >= 5 AND 2 * count(DISTINCT origin) >= count(DISTINCT text)),
k AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, CAST(count(*) FILTER (line <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(piece, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY r, doc_id"""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
wl AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM wl),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM wl WHERE len(ws) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY r),
top AS (SELECT r, max(n) AS top_word_count FROM (SELECT r, word, count(*) AS n FROM w GROUP BY r, word) GROUP BY r),
words AS (SELECT r, count(*) FILTER (ends_with(word, '!')) AS n_shouts, sum(length(word)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT wl.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_shouts, 0) AS n_shouts, coalesce(top_word_count, 0) AS top_word_count
  FROM wl LEFT JOIN rep USING (r) LEFT JOIN top USING (r) LEFT JOIN words USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > word_chars)::INT
  + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (2 * n_shouts > n_words)::INT
  + 32 * (n_words >= 20 AND 100 * top_word_count > 25 * n_words)::INT
  + 64 * (n_words > 0 AND (word_chars > 20 * n_words OR word_chars < 2 * n_words))::INT AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
  (failure_bits & 63) = 0 AS kept, failure_bits FROM f"""

SUBSTRING_DEDUP = r"""
WITH wl AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM wl WHERE len(ws) >= 35)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY gram) AS n FROM g) WHERE n > 1),
near AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM dup),
gone AS (SELECT r, unnest(CASE WHEN gap < 35 THEN range(i + 35 - gap, i + 35) ELSE range(i, i + 35) END) AS i FROM near),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM wl),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM wl LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""

NGRAM_JACCARD = r"""
WITH RECURSIVE wl AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS grams FROM wl),
e AS (SELECT r, hash(unnest(grams)) AS g, len(grams) AS n FROM s),
ranked AS (SELECT r, g, n, row_number() OVER (PARTITION BY r ORDER BY c, g) AS p FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM e)),
prefix AS (SELECT * FROM ranked WHERE p <= n - ceil(0.9 * n) + 1),
pairs AS (SELECT DISTINCT a.r AS x, b.r AS y, a.n AS nx, b.n AS ny FROM prefix a JOIN prefix b ON a.g = b.g AND a.r < b.r),
shared AS (SELECT x, y, nx, ny, count(*) AS both_have FROM pairs JOIN e a ON a.r = x JOIN e b ON b.r = y AND a.g = b.g GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * both_have >= 90 * (nx + ny - both_have)),
tie AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM wl UNION SELECT reach.x, tie.y FROM reach JOIN tie ON tie.x = reach.y)
SELECT wl.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least_id AS component_id FROM wl JOIN s USING (r)
JOIN (SELECT reach.x AS r, min(o.doc_id) AS least_id FROM reach JOIN wl o ON o.r = reach.y GROUP BY reach.x) USING (r)"""
