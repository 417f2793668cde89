"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

OP1 = rf"""
WITH rows AS (
  SELECT doc_id, hash_tie, {_SIZE} AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM (SELECT *, coalesce(text, '') AS hash_tie FROM documents)),
sources AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) - 1 AS rank FROM rows GROUP BY k),
weighed AS (
  SELECT *, list_element([3.0::DOUBLE, 1.0, 2.0], CAST(rank % 3 + 1 AS INT)) AS w,
         CASE WHEN rank % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5 END AS f FROM sources),
knots AS (
  SELECT *, f * w AS w0, (2 - f) * w AS w1, 1.0::DOUBLE * (f * w + (2 - f) * w) / 2 AS area,
         CAST(2 * source_size AS DOUBLE) AS stop FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(stop) OVER (ORDER BY stop / area, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(area) OVER ()
             - coalesce(sum(area) OVER (ORDER BY stop / area, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM knots),
opened AS (SELECT arg_min(level, (stop / area, k)) AS level FROM levels WHERE level <= stop / area),
targets AS (
  SELECT k, source_size, w0, w1, area, coalesce(least(stop, area * (SELECT level FROM opened)), stop) AS target FROM levels),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.w0, t.w1, t.area,
         coalesce(sum(r.size) OVER (PARTITION BY r.k ORDER BY r.place, r.doc_id, r.hash_tie
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows r JOIN targets t USING (k)),
copies AS (
  SELECT *, CAST(greatest(0, least(size, floor(target) - start)) AS BIGINT) AS first_words,
         CAST(greatest(0, least(size, floor(target) - (start + source_size))) AS BIGINT) AS second_words,
         start / nullif(target, 0) * area AS reach
  FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, first_words + second_words AS taken,
       CASE WHEN first_words = 0 THEN NULL WHEN reach <= 0 THEN 0.0
            ELSE least(1.0, 2 * reach / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * reach, 0.0)))) END AS position
FROM copies
"""

OP7 = """
WITH rows AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT payload_digest, max(page_id) AS first_id FROM rows WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND (page_id IS NULL OR page_id < first_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < first_id THEN first_id END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""

#: crc32 is worked out byte by byte from its table, which the first steps build from the polynomial.
OP11 = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
per_doc AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run),
bytes AS (
  SELECT id, run, n, hex(encode(id || ':' || run)) AS h FROM per_doc),
digests AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(h) / 2 AS BIGINT)),
             lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT))),
           lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) AS d
  FROM bytes, crc),
kept AS (
  SELECT CASE WHEN d % 199 = 0 THEN left(run, CAST(d % length(run) AS INT)) || substr(run, CAST(d % length(run) AS INT) + 2) ELSE run END AS word, n
  FROM digests),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (
  SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) t(word, n, i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
named AS (SELECT word, best.top, min(other) AS other, any_value(n_near) AS n_near FROM near JOIN best USING (word) WHERE n = top GROUP BY word, best.top),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN other END AS form, CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN named USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(root, k) FROM chain c WHERE c.word = f.word) AS root, f.n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM forms f
"""

OP12 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
flags AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(again, FALSE) AS INT) AS mask
  FROM texts LEFT JOIN flags USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits
  FROM f a JOIN f b ON b.c <> a.c JOIN f d ON d.c NOT IN (a.c, b.c) JOIN f e ON e.c NOT IN (a.c, b.c, d.c)
  JOIN f g ON g.c NOT IN (a.c, b.c, d.c, e.c)),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
figures AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & CAST(before + bit AS INT) = 0) AS kept,
         sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) = 0) AS removed,
         sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) > 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) = 0) AS good_lost,
         sum(toxic) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) = 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM figures
"""

OP13 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
cut AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM places JOIN (SELECT DISTINCT m FROM windows) ON i + m - 1 <= len(w)),
held AS (SELECT r, i, cut.m, item FROM cut JOIN windows USING (win)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM held) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, item FROM held) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

SQL = {"op1_mixing": OP1, "op7_warc": OP7, "op11_spelling_variants": OP11, "op12_filter_audit": OP12, "op13_decontamination": OP13}
