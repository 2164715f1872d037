"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Characters of [\x20\x09-\x0D], as the operators delete them.
_NORMAL = "translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

_OP3 = f"""
WITH t AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS k,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r"""

_OP6 = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
w AS (SELECT *, translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '' AS word FROM l),
c AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM w WHERE word GROUP BY ALL),
h AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
b AS (SELECT c.source, c.line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE pages > 1 AND pages / total > 0.05),
j AS (SELECT w.*, b.line IS NOT NULL AS gone FROM w LEFT JOIN b ON w.source IS NOT DISTINCT FROM b.source AND w.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

_OP1 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') ELSE '' END AS raw,
             CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
hp AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
o AS (SELECT host, quality AS good FROM hp LEFT JOIN labels ON try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) = doc_id),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good FROM o GROUP BY host),
parts AS (SELECT *, string_split(regexp_replace(host, ':\d*$', ''), '.') AS s FROM hosts),
deep AS (SELECT *, CASE WHEN len(s) > 2 AND length(s[-1]) = 2 AND s[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 3 ELSE least(len(s), 2) END AS take FROM parts),
hd AS (SELECT host, n, good, array_to_string(s[len(s) - take + 1:], '.') AS domain FROM deep),
hs AS (SELECT *, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '^[^.]*\.', '') ELSE domain END AS suffix FROM hd),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hs GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
t AS (SELECT (sum(good) + 0.8::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS m FROM s),
q AS (SELECT 0 AS lv, '' AS key, n, good FROM s WHERE n > 0 UNION ALL SELECT 1, suffix, n, good FROM d WHERE n > 0 UNION ALL SELECT 2, domain, n, good FROM hs WHERE n > 0),
a AS (SELECT lv, key, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS g, count(*)::DOUBLE AS k, sum(round(good * good / n::DOUBLE * 1e6)::BIGINT)::DOUBLE AS q FROM q GROUP BY ALL),
v AS (SELECT *, (q / 1e6 - n * (g / n) * (g / n)) / n AS between_, (g / n) * (1 - g / n) AS within FROM a),
r AS (SELECT *, CASE WHEN within > 0 THEN (between_ / within * (n / k) - 1) / greatest(n / k - 1, 1.0) END AS rho FROM v),
st AS (SELECT lv, key, CASE WHEN k < 2 OR within <= 0 OR rho <= 0 THEN 50.0::DOUBLE ELSE least(greatest(1 / greatest(rho, 1e-9) - 1, 2.0::DOUBLE), 50.0::DOUBLE) END AS k FROM r),
ms AS (SELECT suffix, (good + coalesce(k, 50.0::DOUBLE) * m) / (n + coalesce(k, 50.0::DOUBLE)) AS m FROM s CROSS JOIN t LEFT JOIN st ON lv = 0),
md AS (SELECT domain, (good + coalesce(k, 50.0::DOUBLE) * m) / (n + coalesce(k, 50.0::DOUBLE)) AS m FROM d JOIN ms USING (suffix) LEFT JOIN st ON lv = 1 AND key = suffix),
ab AS (SELECT host, good + coalesce(k, 50.0::DOUBLE) * m AS a, n - good + coalesce(k, 50.0::DOUBLE) * (1 - m) AS b FROM hs JOIN md USING (domain) LEFT JOIN st ON lv = 2 AND key = domain),
up AS (SELECT host, least(1.0::DOUBLE, a / (a + b) + 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS upper_ FROM ab),
f AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM hp)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper_ < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(upper_, 6) AS post_upper
FROM f JOIN up USING (host)"""


#: crc32 of a string of digits: table-free, eight steps a byte.
_CRC = """xor(list_reduce(list_transform(list_concat([''], string_split(cast(c AS VARCHAR), '')), lambda x: CASE WHEN x = '' THEN 4294967295 ELSE ascii(x) END),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""

_OP13 = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 20 AS b, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT v.c, 0 AS part, d, role, text FROM v JOIN t ON t.c = v.b AND d <= h UNION ALL SELECT c, 1, d, role, text FROM v JOIN t USING (c) WHERE d > h),
s AS (SELECT c, list(md5(role || chr(31) || text) ORDER BY part, d) AS path, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, d) AS w FROM r GROUP BY c),
a AS (SELECT c, coalesce(path, []) AS path, coalesce(w, []) AS w FROM v LEFT JOIN s USING (c)),
p AS (SELECT c, unnest(range(len(path) + 1)) AS depth, path, w FROM a),
m AS (SELECT depth, array_to_string(path[1:depth], '/') AS node, array_to_string(path[1:depth - 1], '/') AS up, CASE WHEN depth > 0 THEN w[depth] ELSE 0 END AS words, c, depth = len(path) AS ends, path FROM p),
n AS (SELECT node, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(path[1:depth]) AS path,
             sha256(coalesce(string_agg(cast(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
k AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
x AS (SELECT unnest(range(depth + 1)) AS top, path, n_children, (n_convs - 1) * words AS saved FROM l),
y AS (SELECT top AS depth, array_to_string(path[1:top], '/') AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM x GROUP BY ALL)
SELECT l.conv_id, l.depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, l.ends_sha256
FROM l JOIN y USING (node, depth) LEFT JOIN n AS q ON l.depth > 0 AND q.depth = l.depth - 1 AND q.node = l.up"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_reputation": _OP1, "op3_exact_dedup": _OP3, "op6_line_dedup": _OP6, "op13_prefix_trie": _OP13}
