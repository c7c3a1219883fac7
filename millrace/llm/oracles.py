"""DuckDB SQL for the queries that SQL can express."""

MIXING = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS src, source,
         md5(concat_ws('-', '7', coalesce(CAST(doc_id AS VARCHAR), md5(text), ''))) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
placed AS (
  SELECT *, CAST('0x' || substr(h, 1, 15) AS BIGINT) % (SELECT CAST(ceil(sqrt(greatest(count(*), 1))) AS BIGINT) FROM documents) AS block
  FROM docs),
sources AS (
  SELECT src, source, sum(size) AS n,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS w,
         row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM placed GROUP BY src, source),
filled AS (
  SELECT *, row_number() OVER (ORDER BY 3 * n / w, place) AS k,
         (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3 * n / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM sources),
free AS (SELECT min(k) AS k FROM filled WHERE share * w <= 3 * n),
aimed AS (
  SELECT src, n, CAST(CASE WHEN k < (SELECT k FROM free) THEN 3 * n
                           ELSE w * (SELECT share FROM filled WHERE k = (SELECT k FROM free)) END AS DOUBLE) AS target
  FROM filled),
rounded AS (
  SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n)) ELSE 0 END AS rounds FROM aimed),
summed AS (
  SELECT p.doc_id, p.size, r.n, r.target, r.rounds, r.target - r.rounds * r.n AS rest,
         sum(p.size) OVER (PARTITION BY p.src ORDER BY p.block, p.h, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p.size AS before,
         sum(p.size) OVER (PARTITION BY p.src ORDER BY p.block) - sum(p.size) OVER (PARTITION BY p.src, p.block) AS start
  FROM placed p JOIN rounded r ON p.src = r.src)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(size * (rounds + CASE WHEN start < rest AND before + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""

WARC = """
WITH pages AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
last AS (SELECT digest, max(page_id) AS last FROM pages WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN p.page_id < l.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < l.last THEN l.last END AS refers_to
FROM pages p LEFT JOIN last l ON p.digest = l.digest AND p.n >= 1000
"""

PREFERENCES = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
listed AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS chosen FROM turns GROUP BY conv_id),
paired AS (
  SELECT a.conv_id, a.chosen,
         CASE WHEN b.conv_id IS NULL THEN a.chosen[1:len(a.chosen) - 1]
              ELSE list_concat(a.chosen[1:len(a.chosen) - 1], b.chosen[len(b.chosen):len(b.chosen)]) END AS rejected
  FROM listed a LEFT JOIN listed b ON b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END),
counted AS (
  SELECT *, CAST(coalesce(list_min([i for i in range(1, least(len(chosen), len(rejected)) + 1) if chosen[i] <> rejected[i]]) - 1,
                          least(len(chosen), len(rejected))) AS BIGINT) AS n_common FROM paired),
sides AS (
  SELECT conv_id, n_common, chosen[1:n_common] AS prompt, chosen[n_common + 1:] AS c, rejected[n_common + 1:] AS r FROM counted),
texts AS (
  SELECT conv_id, n_common,
         ['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) for t in prompt] AS p,
         ['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) for t in c] AS ct,
         ['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) for t in r] AS rt, c, r FROM sides)
SELECT conv_id, n_common, coalesce(array_to_string(p, ''), '') AS prompt,
       coalesce(array_to_string(ct, ''), '') AS chosen_text, coalesce(array_to_string(rt, ''), '') AS rejected_text,
       coalesce(array_to_string([CAST(length(coalesce(array_to_string(ct[1:i - 1], ''), '')) + 12 + 9 + 1 AS VARCHAR) || '-' ||
         CAST(length(coalesce(array_to_string(ct[1:i - 1], ''), '')) + 12 + 9 + 1 + length(c[i].text) + 10 AS VARCHAR)
         for i in range(1, len(c) + 1) if c[i].role = 'assistant'], ','), '') AS chosen_mask,
       coalesce(array_to_string([CAST(length(coalesce(array_to_string(rt[1:i - 1], ''), '')) + 12 + 9 + 1 AS VARCHAR) || '-' ||
         CAST(length(coalesce(array_to_string(rt[1:i - 1], ''), '')) + 12 + 9 + 1 + length(r[i].text) + 10 AS VARCHAR)
         for i in range(1, len(r) + 1) if r[i].role = 'assistant'], ','), '') AS rejected_mask
FROM texts
"""

# crc32 by its definition, byte by byte; near words by the texts that remain when one code point is taken out
VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(0 AS BIGINT))),
         lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(CAST(octet_length(encode(s)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT w, n, doc_id || ':' || w AS s FROM runs), crc),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, word AS part, 0 AS at FROM words UNION ALL
  SELECT word, n, left(word, i) || substr(word, i + 2), i + 1 FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.part = b.part AND a.word <> b.word
  WHERE a.at = 0 OR b.at = 0 OR a.at = b.at),
best AS (SELECT word, count(*) AS n_near, arg_min({'n': near_n, 'w': near}, {'n': -near_n, 'w': near}) AS b FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.w END AS form,
         CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best x ON w.word = x.word),
ends AS (
  SELECT word, word AS root FROM forms UNION ALL
  SELECT e.word, f.form FROM ends e JOIN forms f ON e.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM forms f JOIN (SELECT word, arg_max(root, n_root) AS root FROM (
  SELECT e.word, e.root, g.n AS n_root FROM ends e JOIN forms g ON e.root = g.word) GROUP BY word) r ON f.word = r.word
"""
