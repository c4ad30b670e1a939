"""DuckDB SQL for the results of those operators that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r0 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) AS class FROM s),
r AS (SELECT *, [1.0, 2.0, 3.0][class + 1]::DOUBLE AS weight, source_size * 3 AS cap FROM r0),
f AS (SELECT *, sum(source_size) OVER () AS everything, sum(weight) OVER () AS w_all,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS ws FROM r),
g AS (SELECT *, CAST(everything - caps AS DOUBLE) / (w_all - ws) AS share FROM f),
l AS (SELECT *, (SELECT arg_min(share, cap / weight) FROM g WHERE cap > share * weight) AS level FROM g),
t AS (SELECT source, source_size, class, coalesce(least(CAST(cap AS DOUBLE), level * weight), CAST(cap AS DOUBLE)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.class, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS full_, least(size, CAST(floor(target) AS BIGINT) - before_) AS n1 FROM p),
y AS (SELECT *, CASE WHEN n1 > 0 THEN (CAST(before_ AS DOUBLE) + CAST(n1 AS DOUBLE) / 2) / target END AS share FROM q),
k AS (SELECT *, share * (class + 1) AS v, [1.5, 2.0, 1.5][class + 1]::DOUBLE AS x0, [1.0, 2.0, 3.0][class + 1]::DOUBLE AS x1, [-1.0, 0.0, 3.0][class + 1]::DOUBLE AS slope, [0.625, 1.0, 1.125][class + 1]::DOUBLE AS area FROM y)
SELECT doc_id, size, source_size, target, CAST(full_ * size + greatest(least(size, CAST(floor(target - full_ * source_size) AS BIGINT) - before_), 0) AS BIGINT) AS taken,
    CASE WHEN share IS NULL THEN NULL
         WHEN v <= area THEN least(0.0::DOUBLE + CASE WHEN slope = 0 THEN v / x0 ELSE (sqrt(greatest(x0 * x0 + v * (2 * slope), 0.0)) - x0) / slope END, 0.5::DOUBLE)
         ELSE least(0.5::DOUBLE + CASE WHEN slope = 0 THEN (v - area) / x1 ELSE (sqrt(greatest(x1 * x1 + (v - area) * (2 * slope), 0.0)) - x1) / slope END, 1.0::DOUBLE) END AS position
FROM k
"""

OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2) UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.id WHERE c.root < u.b),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(m.root, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id
"""

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS t FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON bw.n = dw.n AND bw.t = dw.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP5 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
b AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(bits, i * 5 + k + 1, 1) AS INT) * CAST(pow(2, 4 - k) AS INT))) AS INT) + 1, 1)), '') AS payload_digest FROM b),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_ FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_ IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_ IS DISTINCT FROM page_id THEN first_ END AS refers_to FROM m
"""

OP10 = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id WHERE c.root < l.b),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.root, e.vec_id) AS component_id, coalesce(m.root, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP12 = r"""
WITH RECURSIVE bits AS (SELECT range::UINTEGER AS i, range::UINTEGER AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM g),
h AS (SELECT run, n, CAST(xor(list_reduce(list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(k * 2 + 1 AS BIGINT), 2) AS UINTEGER)), lambda a, v: xor(a >> 8, crc[CAST(xor(a, v) & 255 AS BIGINT) + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER) AS BIGINT) AS h FROM b, t),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
half AS (SELECT word, n, m, 'f' || substr(word, 1, m // 2) AS key FROM (SELECT word, n, unnest([length(word), length(word) - 1]) AS m FROM w) UNION ALL
    SELECT word, n, m, 'b' || substr(reverse(word), 1, m - m // 2) FROM (SELECT word, n, unnest([length(word), length(word) - 1]) AS m FROM w)),
p AS (SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM half a JOIN half b ON a.m = b.m AND a.key = b.key AND a.word <> b.word WHERE abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(translate(a.word, LATIN, PLAIN), translate(b.word, LATIN, PLAIN)) = 1),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n, CASE WHEN top >= 5 * w.n THEN (SELECT min(encode(near)) FROM p WHERE p.word = w.word AND p.near_n = best.top) END AS form_b FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, n, n_near, form_n, decode(form_b) AS form FROM f),
c AS (SELECT word, word AS root, 0 AS steps FROM r UNION ALL SELECT c.word, r.form, steps + 1 FROM c JOIN r ON r.word = c.root WHERE r.form IS NOT NULL),
z AS (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM r JOIN z USING (word)
"""
# levenshtein() counts bytes there: the 64 letters beyond ASCII become 64 other single bytes
OP12 = OP12.replace("LATIN", "'" + "".join(map(chr, range(0xC0, 0x100))) + "'").replace("PLAIN", "'" + "".join(map(chr, range(0x21, 0x61))).replace("'", "''") + "'")

OP13 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
tot AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, ws[i:i + k - 1] AS ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
sub AS (SELECT lang, ph[1:len(ph) - 1] AS ph, f FROM f WHERE len(ph) > 2 UNION ALL SELECT lang, ph[2:], f FROM f WHERE len(ph) > 2),
gone AS (SELECT DISTINCT f.lang, f.ph FROM f JOIN sub ON f.lang = sub.lang AND f.ph = sub.ph AND sub.f >= f.f),
c AS (SELECT lang, ph, f AS a, unnest(range(1, len(ph))) AS k FROM f WHERE len(ph) > 1 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = f.lang AND gone.ph = f.ph)),
s AS (SELECT c.lang, c.ph, c.a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:] JOIN tot ON tot.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM m)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
