"""Administration and product pages, lifecycle rules and table upkeep, as SQL over the tables.

The same conventions as in analytics: one statement for both engines where they agree.
"""

from __future__ import annotations

from docweave.plans.analytics import AS_OF, add

# pages of the administration -----------------------------------------------------------------------

add(
    "model_stats",
    "SELECT o_orderpriority AS model, count(*) AS calls, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS tenants FROM {orders} GROUP BY o_orderpriority",
)
add(
    "ingestion_errors_top",
    "SELECT source, count(*) AS failed, min(doc_id) AS first_doc FROM {documents} WHERE n_chars < 200 GROUP BY source ORDER BY failed DESC, source LIMIT 10",
)
add(
    "search_source_share_daily",
    """
SELECT day, event_type, n, zero, round(100e0 * n / sum(n) OVER (PARTITION BY day), 1) AS pct FROM (
  SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value < 10) AS zero FROM {events} GROUP BY CAST(ts AS DATE), event_type) t
""",
)
add(
    "tool_call_stats",
    """
SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS tenants, count(*) FILTER (WHERE value > 100) AS slow,
  round(avg(value) FILTER (WHERE value > 0), 4) AS mean_ms, round(100e0 * count(*) FILTER (WHERE value < 5) / count(*), 2) AS error_pct
FROM {events} GROUP BY event_type
""",
)
add(
    "request_list_page",
    """
SELECT e.event_id, e.event_type, e.value, c.c_name AS tenant FROM (
  SELECT event_id, event_type, value, user_id, ts FROM {events} WHERE event_type ILIKE '%c%' AND value >= 20 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40) e
LEFT JOIN {customer} c ON c.c_custkey = e.user_id ORDER BY e.ts DESC, e.event_id DESC
""",
)
add("request_list_total", "SELECT count(*) AS total FROM {events} WHERE event_type ILIKE '%c%' AND value >= 20")
add(
    "tenant_list",
    """
SELECT c.c_custkey, c.c_name, coalesce(o.orders, 0) AS orders, coalesce(o.total, 0e0) AS total, coalesce(e.calls, 0) AS calls FROM {customer} c
LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT user_id, count(*) AS calls FROM {events} GROUP BY user_id) e ON e.user_id = c.c_custkey
WHERE c.c_mktsegment <> 'MACHINERY'
""",
)
add(
    "admin_document_list",
    """
SELECT d.doc_id, d.source, d.lang, CASE WHEN l.n IS NULL THEN 0 ELSE l.n END AS keys FROM {documents} d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM {labels} GROUP BY doc_id) l ON l.doc_id = d.doc_id
WHERE d.source ILIKE '%e%' OR d.lang ILIKE 'd%' ORDER BY d.doc_id DESC LIMIT 50
""",
)
add(
    "role_tenant_counts",
    "SELECT n.n_nationkey, n.n_name, count(c.c_custkey) AS tenants FROM {nation} n LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 0 GROUP BY n.n_nationkey, n.n_name",
)
add(
    "api_key_usage",
    """
SELECT k.s_suppkey AS key_id, k.s_name AS key_name, coalesce(u.calls, 0) AS calls, u.last_used, coalesce(u.total, 0e0) AS total FROM {supplier} k
LEFT JOIN (SELECT l_suppkey, count(*) AS calls, max(l_shipdate) AS last_used, round(sum(l_extendedprice), 2) AS total FROM {lineitem} GROUP BY l_suppkey) u ON u.l_suppkey = k.s_suppkey
""",
)
add(
    "product_debug",
    """
SELECT p.p_partkey, p.p_name, p.p_brand, count(l.l_orderkey) AS chunks, count(DISTINCT l.l_suppkey) AS documents, coalesce(round(sum(l.l_quantity), 2), 0) AS tokens,
  coalesce(round(min(l.l_quantity), 2), 0) AS least, coalesce(round(max(l.l_quantity), 2), 0) AS most, count(*) FILTER (WHERE l.l_returnflag = 'R') AS returned
FROM {part} p LEFT JOIN {lineitem} l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey, p.p_name, p.p_brand
""",
)
add(
    "product_search_keys",
    "SELECT p_brand, array_join(sort_array(collect_set(lower(p_name))), ', ') AS keys, count(DISTINCT lower(p_name)) AS n FROM {part} GROUP BY p_brand",
    "SELECT p_brand, string_agg(DISTINCT lower(p_name), ', ' ORDER BY lower(p_name)) AS keys, count(DISTINCT lower(p_name)) AS n FROM part GROUP BY p_brand",
)
add(
    "product_usage_stats",
    """
SELECT l_partkey, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT l_suppkey) AS documents, count(*) FILTER (WHERE l_returnflag = 'A') AS thumbs_up,
  count(*) FILTER (WHERE l_returnflag = 'R') AS thumbs_down, round(avg(l_discount), 4) AS mean_similarity FROM {lineitem} GROUP BY l_partkey
""",
)
add(
    "document_usage_top_headings",
    """
SELECT l_suppkey, l_partkey, hits FROM (
  SELECT l_suppkey, l_partkey, hits, row_number() OVER (PARTITION BY l_suppkey ORDER BY hits DESC, l_partkey) AS rn FROM (
    SELECT l_suppkey, l_partkey, count(*) AS hits FROM {lineitem} GROUP BY l_suppkey, l_partkey) g) r WHERE rn <= 10
""",
)
add("queue_stats", "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM {orders} GROUP BY o_orderstatus")
add(
    "quota_check",
    """
SELECT c.c_custkey, coalesce(o.done, 0) + coalesce(e.pending, 0) AS used, coalesce(o.done, 0) + coalesce(e.pending, 0) + 1000 > 500000 AS exceeded FROM {customer} c
LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS done FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT user_id, round(sum(value), 2) AS pending FROM {events} WHERE event_type = 'purchase' GROUP BY user_id) e ON e.user_id = c.c_custkey
""",
)
add(
    "task_states_merged",
    """
SELECT coalesce(o.o_orderkey, l.l_orderkey) AS task, coalesce(l.live, o.o_orderstatus) AS state, l.live IS NOT NULL AS queued FROM {orders} o
FULL OUTER JOIN (SELECT l_orderkey, max(l_linestatus) AS live FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
""",
)
add(
    "shared_links_page",
    f"""
SELECT o.o_orderkey, o.o_orderdate, c.c_name, o.o_orderdate < {AS_OF} - INTERVAL 9000 DAY AS expired FROM (
  SELECT o_orderkey, o_orderdate, o_custkey FROM {{orders}} WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) o
LEFT JOIN {{customer}} c ON c.c_custkey = o.o_custkey
""",
)
add(
    "reindex_jobs",
    """
SELECT j.l_orderkey AS job, j.done, j.parts, round(100e0 * j.done / j.parts, 1) AS progress_pct, j.last_seen, j.done < j.parts AND j.last_seen < TIMESTAMP '1996-01-01 00:00:00' AS stale FROM (
  SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS done, count(*) AS parts, max(l_shipdate) AS last_seen FROM {lineitem} GROUP BY l_orderkey) j
""",
)
add(
    "evaluation_rollup",
    """
SELECT conv_id, round(avg(CASE WHEN length(text) > 200 THEN 1e0 ELSE 0e0 END), 4) AS mrr, round(avg(least(1e0, greatest(0e0, length(text) / 400e0))), 4) AS precision_mean,
  count(*) AS samples FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id
""",
)
add(
    "session_detail",
    """
SELECT m.conv_id, m.turn, m.role, length(m.text) AS chars, e.value AS cost FROM {conversations} m
LEFT JOIN {events} e ON e.event_id = m.conv_id * 10 + m.turn
""",
)
add("message_search", "SELECT conv_id, turn, substr(text, 1, 200) AS preview FROM {conversations} WHERE text ILIKE '%the%' ORDER BY conv_id, turn LIMIT 30")
add(
    "autosuggest",
    "SELECT name, hits FROM (SELECT lower(p_name) AS name, count(*) AS hits FROM {part} WHERE p_name ILIKE 're%' OR p_name ILIKE '%bolt%' GROUP BY lower(p_name)) s ORDER BY hits DESC, name LIMIT 10",
)
add(
    "suggestion_chips",
    """
SELECT s.name, s.pos, t.template FROM (
  SELECT name, row_number() OVER (ORDER BY hits DESC, name) AS pos FROM (
    SELECT lower(p_name) AS name, count(*) AS hits FROM {part} GROUP BY lower(p_name) ORDER BY hits DESC, name LIMIT 4) g) s
JOIN (SELECT 1 AS pos, 'How do I set it up?' AS template UNION ALL SELECT 2, 'Which endpoints are there?' UNION ALL SELECT 3, 'What does the error mean?' UNION ALL SELECT 4, 'Show an example.') t ON t.pos = s.pos
""",
)
add(
    "code_examples_first",
    """
SELECT page_id, kind FROM (SELECT page_id, CASE WHEN html LIKE '%<pre%' THEN 'example' WHEN html LIKE '%<code%' THEN 'inline' ELSE 'other' END AS kind FROM {pages}
  WHERE html LIKE '%<pre%' OR html LIKE '%<code%' OR html LIKE '%<table%' OR html LIKE '%<script%') k
ORDER BY CASE kind WHEN 'example' THEN 0 WHEN 'inline' THEN 1 ELSE 2 END, page_id LIMIT 15
""",
)
add(
    "section_lookup",
    "SELECT page_id, heading FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS heading FROM {pages}) h WHERE heading ILIKE '%the%' ORDER BY page_id LIMIT 20",
)
add(
    "endpoint_lookup",
    """
WITH p AS (SELECT page_id, lower(regexp_replace(url, '^[a-z]+://', '')) AS path FROM {pages}), hit AS (SELECT page_id, 1e0 AS similarity FROM p WHERE path LIKE '%/en/77%' ORDER BY page_id LIMIT 10)
SELECT page_id, similarity FROM hit
UNION ALL SELECT page_id, similarity FROM (SELECT page_id, 0.5e0 AS similarity FROM p WHERE path LIKE '%/en/%' AND NOT EXISTS (SELECT 1 FROM hit) ORDER BY page_id LIMIT 5) f
""",
)
add(
    "threshold_fallback",
    """
SELECT conv_id, turn, score, passes FROM (
  SELECT conv_id, turn, score, score >= 0.35 AS passes, max(CASE WHEN score >= 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS any_passes FROM (
    SELECT conv_id, turn, round(least(1e0, length(text) / 2000e0), 4) AS score FROM {conversations}) s) f
WHERE passes OR any_passes = 0
""",
)
add(
    "parent_shown_once",
    "SELECT d.doc_id, d.doc_id = f.first_doc AS shown FROM (SELECT doc_id, sha2(text, 256) AS h FROM {documents}) d JOIN (SELECT sha2(text, 256) AS h, min(doc_id) AS first_doc FROM {documents} GROUP BY sha2(text, 256)) f ON f.h = d.h",
    "SELECT d.doc_id, d.doc_id = f.first_doc AS shown FROM (SELECT doc_id, sha256(text) AS h FROM documents) d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_doc FROM documents GROUP BY sha256(text)) f ON f.h = d.h",
)
add(
    "running_average_hits",
    """
SELECT p.p_partkey, p.p_size + u.k AS hits, (p.p_retailprice * p.p_size + u.total) / (p.p_size + u.k) AS mean_similarity FROM {part} p
JOIN (SELECT l_partkey, count(*) AS k, CAST(sum(CAST(l_discount AS DECIMAL(6, 2))) AS DOUBLE) AS total FROM {lineitem} GROUP BY l_partkey) u ON u.l_partkey = p.p_partkey
""",
)
add("embedding_cost", "SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity <= 0 THEN 0 ELSE CAST(l_quantity * 1000 AS DECIMAL(12, 0)) * CAST(0.00000015 AS DECIMAL(10, 8)) END) AS DECIMAL(22, 8)) AS cost FROM {lineitem} GROUP BY l_orderkey")
add(
    "tool_call_cost",
    """
SELECT event_id, CAST(CAST(0.0001 AS DECIMAL(12, 8)) + CAST(CASE WHEN event_type = 'view' THEN 0.00005 ELSE 0 END AS DECIMAL(12, 8)) + CAST(CASE WHEN value > 50 THEN 0.00025 ELSE 0 END AS DECIMAL(12, 8)) AS DECIMAL(14, 8)) AS cost FROM {events}
""",
)

# lifecycle rules --------------------------------------------------------------------------------------

_PHASES = """
SELECT l_orderkey AS doc, l_linenumber AS pos, concat('step', CAST(l_partkey % 7 AS VARCHAR(9))) AS action, concat('step', CAST(l_suppkey % 7 AS VARCHAR(9))) AS needs,
  CASE l_linenumber % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE 'PUT' END AS method, l_returnflag = 'A' AS has_example, l_discount > 0.04 AS covered,
  l_tax > 0.06 AS is_auth FROM {lineitem}"""
add(
    "lifecycle_rules",
    f"""
WITH phases AS ({_PHASES}), per_doc AS (
  SELECT doc, avg(CASE WHEN covered THEN 1e0 ELSE 0e0 END) AS coverage, bool_or(is_auth) AS auth, count(*) FILTER (WHERE method IN ('POST', 'PUT', 'PATCH') AND NOT has_example) AS missing FROM phases GROUP BY doc)
SELECT o.o_orderkey AS doc, 'no phases' AS issue FROM {{orders}} o WHERE NOT EXISTS (SELECT 1 FROM {{lineitem}} l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL SELECT doc, 'coverage below half' FROM per_doc WHERE coverage < 0.5
UNION ALL SELECT doc, 'no authentication phase' FROM per_doc WHERE NOT auth
UNION ALL SELECT doc, 'missing request examples' FROM per_doc WHERE missing BETWEEN 1 AND 5
UNION ALL SELECT p.doc, concat('unknown action ', p.needs) FROM (SELECT DISTINCT doc, needs FROM phases) p
  LEFT JOIN (SELECT DISTINCT doc, action FROM phases) a ON a.doc = p.doc AND a.action = p.needs WHERE a.action IS NULL
""",
)
add(
    "lifecycle_quality",
    """
SELECT l_orderkey, round(avg(s), 2) AS score, CASE WHEN avg(s) >= 80 THEN 'GOOD' WHEN avg(s) >= 50 THEN 'PARTIAL' ELSE 'LOW' END AS label
FROM (SELECT l_orderkey, l_quantity * 2 AS s FROM {lineitem}) q GROUP BY l_orderkey
""",
)
add(
    "issue_dedup",
    "SELECT lower(p_name) AS description, lower(p_type) AS entity, min(p_partkey) AS first_seen, count(*) AS reported FROM {part} GROUP BY lower(p_name), lower(p_type)",
)

# table upkeep: what the table holds after the change -----------------------------------------------------------

add(
    "insert_or_ignore",
    "SELECT doc_id, quality, 'old' AS origin FROM {labels} UNION ALL SELECT d.doc_id, 0, 'new' FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)",
)
add(
    "update_from_backfill",
    """
SELECT d.doc_id, coalesce(d.lang, s.usual, 'other') AS lang FROM {documents} d LEFT JOIN (
  SELECT source, min(lang) AS usual FROM {documents} WHERE lang IS NOT NULL GROUP BY source) s ON s.source = d.source
""",
)
add("delete_cascade", "SELECT l.l_orderkey, l.l_linenumber FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
add(
    "skip_same_hash",
    "SELECT d.doc_id, h.first_doc < d.doc_id AS skipped FROM (SELECT doc_id, source, sha2(text, 256) AS h FROM {documents}) d JOIN (SELECT source, sha2(text, 256) AS h, min(doc_id) AS first_doc FROM {documents} GROUP BY source, sha2(text, 256)) h ON h.source = d.source AND h.h = d.h",
    "SELECT d.doc_id, h.first_doc < d.doc_id AS skipped FROM (SELECT doc_id, source, sha256(text) AS h FROM documents) d JOIN (SELECT source, sha256(text) AS h, min(doc_id) AS first_doc FROM documents GROUP BY source, sha256(text)) h ON h.source = d.source AND h.h = d.h",
)
add(
    "status_desync",
    """
SELECT o.o_orderkey, o.o_orderstatus, CASE WHEN l.open = 0 AND o.o_orderstatus <> 'F' THEN 'F' WHEN l.open > 0 AND o.o_orderstatus = 'F' THEN 'O' ELSE o.o_orderstatus END AS healed
FROM {orders} o JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
""",
)
add("orphans", "SELECT o_orderkey, o_custkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)")

# windows over time --------------------------------------------------------------------------------------------

add(
    "window_sliding",
    "SELECT w.window.start AS bucket, count(*) AS n, round(sum(w.value), 4) AS total FROM (SELECT window(ts, '1 hour', '15 minutes') AS window, value FROM {events}) w GROUP BY w.window.start",
    """
SELECT bucket, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS bucket, value FROM events) s GROUP BY bucket
""",
)
add("window_count_5m", "SELECT window.start AS bucket, count(*) AS n FROM {events} GROUP BY window(ts, '5 minutes')", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
add(
    "gauge_percent",
    "SELECT p_partkey, round(100 - 100e0 * p_size / 50, 4) AS used_pct, 100 - 100e0 * p_size / 50 > 80 AS breached FROM {part}",
)
