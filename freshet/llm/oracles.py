"""DuckDB SQL of the training-data operators that SQL can express."""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY text
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, a, b, c, d, e
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS earlier FROM orders, range(1, 6) t(step)
), met AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(earlier, lambda x: x <> '' AND f[x])) > 0 AS gone,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x])) = 1 AS single
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND single), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
), named AS (
  SELECT doc_id, len(s) AS n_shingles, min(doc_id) OVER (PARTITION BY list_sort(s)) AS node FROM sets
), nodes AS (
  SELECT node, any_value(s) AS s FROM named JOIN sets USING (doc_id) WHERE len(s) > 0 GROUP BY node
), each AS (
  SELECT node, len(s) AS n, hash(unnest(s)) AS h FROM nodes
), edges AS (
  SELECT x.node AS a, y.node AS b FROM each x JOIN each y ON x.h = y.h AND x.node < y.node AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT node, node AS other FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), roots AS (
  SELECT node, min(other) AS root FROM reach GROUP BY node
)
SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, CASE WHEN n.n_shingles = 0 THEN n.doc_id ELSE r.root END AS component_id FROM named n LEFT JOIN roots r USING (node)
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS bytes FROM conversations
), drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM drawn JOIN range(2) c(copy) ON copy = 0 OR k = 3 WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY 1
), togo AS (
  SELECT conv_id, n + 1 AS i, [0, 10, 5, 0] AS v FROM stats
  UNION ALL
  SELECT conv_id, i, [least(w[1], 5 + w[3]), least(w[2], 5 + w[3]), least(w[3], 5 + w[4]), least(w[4], 5 + w[3])] FROM (
    SELECT conv_id, i, [least(u[1], 5 + u[3]), least(u[2], 5 + u[3]), least(u[3], 5 + u[4]), least(u[4], 5 + u[3])] AS w FROM (
      SELECT f.conv_id, f.i, [
        least(2 + v[1], CASE WHEN free THEN 1 + x + v[3] ELSE 1000000000 END, CASE WHEN free AND r = 's' THEN x + v[2] WHEN free AND r = 'u' THEN x + v[3] ELSE 1000000000 END),
        least(2 + v[2], CASE WHEN free THEN 1 + x + v[3] ELSE 1000000000 END, CASE WHEN free AND r = 'u' THEN x + v[3] ELSE 1000000000 END),
        least(2 + v[3], CASE WHEN free THEN 1 + x + v[4] ELSE 1000000000 END, CASE WHEN free AND r = 'a' THEN x + v[4] ELSE 1000000000 END),
        least(2 + v[4], CASE WHEN free THEN 1 + x + v[3] ELSE 1000000000 END, CASE WHEN free AND r = 'u' THEN x + v[3] ELSE 1000000000 END)] AS u
      FROM togo g JOIN (SELECT *, fault NOT IN ('b', 'd') AS free, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS x FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i - 1))
), cost AS (
  SELECT g.conv_id, g.i, g.v, h.v AS ahead, f.r, f.fault NOT IN ('b', 'd') AS free, CASE WHEN f.fault = 't' THEN 5 ELSE 0 END AS x, f.role, f.text
  FROM togo g LEFT JOIN togo h ON h.conv_id IS NOT DISTINCT FROM g.conv_id AND h.i = g.i + 1 LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = g.i
), walk AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS turns FROM stats
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE other END, audit || edit,
    CASE edit WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text) ELSE list_append(turns, CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT *, CASE WHEN v[q] = 2 + ahead[q] THEN 'D' WHEN v[q] = 5 + v[other] THEN 'I' WHEN free AND kept IS NOT NULL AND v[q] = x + ahead[kept] THEN 'K' ELSE 'R' END AS edit FROM (
      SELECT w.*, c.v, c.ahead, c.free, c.x, c.role, c.text, CASE WHEN w.q = 3 THEN 4 ELSE 3 END AS other,
        CASE WHEN w.q = 1 AND c.r = 's' THEN 2 WHEN w.q IN (1, 2, 4) AND c.r = 'u' THEN 3 WHEN w.q = 3 AND c.r = 'a' THEN 4 END AS kept
      FROM walk w JOIN cost c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i WHERE c.ahead IS NOT NULL OR c.v[w.q] > 0))
), done AS (
  SELECT w.conv_id, w.audit, w.turns FROM walk w JOIN cost c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i WHERE c.ahead IS NULL AND c.v[w.q] = 0
), first AS (
  SELECT conv_id, v[1] AS cost FROM togo WHERE i = 1
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN first f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
