"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH low AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, list_slice(w, i, i + least(len(w), 13) - 1) AS win
  FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0
), pos AS (
  SELECT doc_id, k, i AS p0, list_slice(w, i, i + k - 1) AS win
  FROM low, (SELECT DISTINCT k FROM win) s, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k
), hit AS (SELECT doc_id, item_id, p0, p.k FROM pos p JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p0 + j) AS n_hit FROM (SELECT DISTINCT doc_id, p0, k FROM hit) h, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


OP4 = r"""
WITH RECURSIVE u AS (
  SELECT DISTINCT conv_id, turn, text, (turn // 2) % 4 AS k,
    'c' || conv_id || '-' || CASE WHEN (turn // 2) % 4 = 3 AND conv_id % 3 = 1 THEN turn - 2 ELSE turn END AS call_id,
    'c' || conv_id || '-' || CASE WHEN (turn // 2) % 4 = 1 THEN turn + 2 WHEN (turn // 2) % 4 > 1 THEN turn - 4 WHEN conv_id % 5 = 3 AND turn < 2 THEN turn END AS ref
  FROM conversations WHERE role = 'user'
), f AS (
  SELECT conv_id, call_id, min(turn) AS turn, count(*) AS n_calls, arg_min(text, turn) AS question, arg_min(k, turn) AS k,
    arg_min({'r': ref}, turn).r AS ref FROM u GROUP BY conv_id, call_id
), a AS (
  SELECT conv_id, call_id, min(turn) AS turn, arg_min(text, turn) AS content, count(*) AS n_results
  FROM (SELECT DISTINCT conv_id, turn, text, 'c' || conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant') GROUP BY conv_id, call_id
), d AS (SELECT f.conv_id, f.call_id, f.ref, (g.turn >= f.turn)::BIGINT AS back FROM f JOIN f g ON g.conv_id = f.conv_id AND g.call_id = f.ref),
most AS (SELECT conv_id, sum(back)::BIGINT AS most FROM d GROUP BY conv_id HAVING sum(back) > 0),
ep AS (
  SELECT f.conv_id, f.call_id, CASE WHEN f.ref = f.call_id THEN most + 1 ELSE 0 END AS epoch FROM f JOIN most USING (conv_id)
  UNION
  SELECT d.conv_id, d.call_id, ep.epoch + d.back FROM ep JOIN d ON d.conv_id = ep.conv_id AND d.ref = ep.call_id WHERE d.ref <> d.call_id
), eo AS (SELECT conv_id, call_id, max(epoch) AS epoch, max(epoch) > any_value(most) AS cyclic FROM ep JOIN most USING (conv_id) GROUP BY conv_id, call_id),
j AS (
  SELECT coalesce(f.conv_id, a.conv_id) AS conv_id, f.turn AS turn, coalesce(f.call_id, a.call_id) AS call_id, a.turn AS result_turn, n_calls, n_results,
    f.question AS question, a.content AS content, f.call_id IS NOT NULL AS called, a.call_id IS NOT NULL AS answered, f.ref AS ref, f.k AS k,
    f.ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f v WHERE v.conv_id = f.conv_id AND v.call_id = f.ref) AS lost
  FROM f FULL JOIN a ON f.conv_id = a.conv_id AND f.call_id = a.call_id
), e AS (
  SELECT j.*, concat_ws('; ', CASE WHEN called AND conv_id % 4 = 1 AND k = 1 THEN 'mistyped n_chars' WHEN called AND conv_id % 4 = 2 AND k = 2 THEN 'missing n_chars' WHEN called AND conv_id % 4 = 3 AND k = 0 THEN 'unknown mood' END,
    CASE WHEN called AND lost THEN 'no call ' || ref END) AS errors,
    concat_ws(',', CASE WHEN ref IS NOT NULL THEN '"after":"${' || ref || '}"' END, CASE WHEN conv_id % 4 = 3 AND k = 0 THEN '"mood":"calm"' END,
      CASE WHEN conv_id % 4 = 2 AND k = 2 THEN NULL WHEN conv_id % 4 = 1 AND k = 1 THEN '"n_chars":"' || length(question) || '"' ELSE '"n_chars":' || length(question) END,
      '"text":' || to_json(question)::VARCHAR) AS body
  FROM j
)
SELECT e.conv_id, turn, CASE WHEN called THEN 0 END AS place, e.call_id, CASE WHEN called THEN 'answer' END AS name,
  CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status, result_turn,
  CAST(coalesce(epoch, 0) AS INTEGER) AS epoch, coalesce(cyclic, false) AS cyclic,
  called AND errors = '' AS valid, errors, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results,
  '{"arguments":' || CASE WHEN called THEN '{' || body || '}' ELSE 'null' END
    || ',"call":' || to_json(e.call_id)::VARCHAR || ',"name":' || CASE WHEN called THEN '"answer"' ELSE 'null' END
    || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null')
    || ',"status":"' || CASE WHEN NOT called THEN 'orphan' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END || '"}' AS record
FROM e LEFT JOIN eo ON eo.conv_id = e.conv_id AND eo.call_id = e.call_id
"""

OP7 = r"""
WITH p AS (
  SELECT DISTINCT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((page_id * 37) % 8760 AS INTEGER)) AS fetched
  FROM pages
), h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
d AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS host FROM h),
n AS (SELECT *, [('0x' || substr(md5(host), 1, 4))::INT, ('0x' || substr(md5(host), 5, 4))::INT, ('0x' || substr(md5(host), 17, 4))::INT] AS v FROM h),
m AS (SELECT *, [('0x' || substr(md5(host), 9, 4))::INT, ('0x' || substr(md5(host), 13, 4))::INT] AS v FROM d),
e AS (
  SELECT host AS key, 3 AS rank, v[2] % 200 AS days FROM n WHERE v[1] % 3 = 0
  UNION ALL SELECT host, 1, v[2] % 200 + 60 FROM n WHERE v[1] % 3 = 0
  UNION ALL SELECT host, 3, v[2] % 200 + 150 FROM n WHERE v[1] % 3 = 0
  UNION ALL SELECT host, 3, v[2] % 300 FROM m WHERE v[1] % 10 = 0
  UNION ALL SELECT host || '/en', 2, v[3] % 250 FROM n WHERE v[1] % 3 = 0
), g AS (SELECT key, TIMESTAMP '2024-01-01 00:00:00' + to_days(days) AS since, max(rank) AS rank FROM e GROUP BY ALL),
s AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until FROM g),
j AS (
  SELECT page_id, url, fetched, host, key, rank, since,
    row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY CASE WHEN instr(key, '/') > 0 THEN length(key) - instr(key, '/') + 1 ELSE 0 END DESC, length(key) DESC) AS r
  FROM p JOIN s ON rank > 1 AND since <= fetched AND (until IS NULL OR fetched < until) AND (
    host = key OR host LIKE '%.' || key
    OR (instr(key, '/') > 0 AND (host = split_part(key, '/', 1) OR host LIKE '%.' || split_part(key, '/', 1)) AND split_part(path, '/', 2) = split_part(key, '/', 2)))
)
SELECT p.page_id, p.url, p.host, strftime(p.fetched, '%Y-%m-%d %H:%M:%S') AS fetched, coalesce(j.rank = 3, false) AS blocked, j.key AS rule,
  strftime(j.since, '%Y-%m-%d %H:%M:%S') AS rule_since
FROM p LEFT JOIN (SELECT * FROM j WHERE r = 1) j ON p.page_id IS NOT DISTINCT FROM j.page_id AND p.url IS NOT DISTINCT FROM j.url
"""

OP8 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_exact_dedup": OP2, "op4_tool_calls": OP4, "op7_url_lists": OP7, "op8_warc_revisits": OP8}
