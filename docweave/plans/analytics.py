"""Usage, cost, quality and session analytics, as SQL over the tables.

A statement names its tables in braces; Spark gets them as DataFrames, so no
temporary view is registered.  ``as_of`` is fixed where a query looks back in time.
Where both engines read the same text, one statement is the query and its oracle;
otherwise ``oracle`` holds the other engine's.
"""

from __future__ import annotations

from dataclasses import dataclass

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


@dataclass(frozen=True)
class Statement:
    sql: str
    oracle: str | None = None


STATEMENTS: dict[str, Statement] = {}


def add(key: str, sql: str, oracle: str | None = None) -> None:
    STATEMENTS[key] = Statement(sql, oracle)


# overview, usage and models --------------------------------------------------------------------

add(
    "platform_overview",
    f"""
SELECT (SELECT count(*) FROM {{documents}}) AS documents, (SELECT count(*) FROM {{customer}}) AS tenants,
  count(*) AS events, count(DISTINCT user_id) AS users, round(coalesce(sum(value), 0), 2) AS total_value,
  round(min(value), 2) AS least, round(max(value), 2) AS most,
  count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
FROM {{events}} WHERE ts >= {AS_OF} - INTERVAL 30 DAY
""",
)
add("usage_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS calls, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM {events} GROUP BY CAST(ts AS DATE)")
add("usage_by_action", "SELECT event_type AS action, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM {events} GROUP BY event_type ORDER BY calls DESC, action")
add(
    "top_tenants",
    """
SELECT u.user_id, c.c_name AS tenant, u.calls, u.total FROM (
  SELECT user_id, count(*) AS calls, round(sum(value), 2) AS total FROM {events} GROUP BY user_id
) u JOIN {customer} c ON c.c_custkey = u.user_id ORDER BY u.calls DESC, u.user_id LIMIT 10
""",
)
add(
    "usage_pct_share",
    """
SELECT event_type, n, round(100e0 * n / sum(n) OVER (), 1) AS pct FROM (
  SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type) t
""",
)
add(
    "latency_percentiles",
    """
SELECT event_type, round(q[0], 6) AS p50, round(q[1], 6) AS p75, round(q[2], 6) AS p90, round(q[3], 6) AS p95 FROM (
  SELECT event_type, percentile(value, array(0.5, 0.75, 0.9, 0.95)) AS q FROM {events} GROUP BY event_type) p
""",
    """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
  round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type
""",
)
add(
    "conditional_counts_pivot",
    """
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors,
  CAST(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS conversions,
  count(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id
""",
)
add(
    "rag_eval_segmented",
    """
SELECT event_type AS query_type, count(*) AS answers, round(avg(value), 4) AS mean_similarity,
  count(*) FILTER (WHERE value < 35) AS empty_retrievals,
  round(count(*) FILTER (WHERE value < 35) * 1e0 / nullif(count(*), 0), 4) AS empty_rate,
  round(avg(CASE WHEN value >= 50 THEN 1e0 ELSE 0e0 END), 4) AS mrr
FROM {events} GROUP BY event_type ORDER BY answers DESC, query_type LIMIT 20
""",
)
add(
    "zero_result_rate_daily",
    """
SELECT CAST(ts AS DATE) AS day, count(*) AS searches, CAST(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS BIGINT) AS zero_results,
  round(avg(value), 4) AS mean_similarity FROM {events} WHERE event_type = 'view' GROUP BY CAST(ts AS DATE)
""",
)
add(
    "top_queries",
    "SELECT lang, source, count(*) AS n, round(avg(n_chars), 2) AS mean_chars FROM {documents} GROUP BY lang, source ORDER BY n DESC, lang, source LIMIT 20",
)
add(
    "error_rate_corrected",
    """
SELECT user_id, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error' AND event_type IS NOT NULL) * 100e0 / nullif(count(*), 0), 2) AS error_pct
FROM {events} GROUP BY user_id
""",
)
add(
    "cost_per_day_forecast",
    f"""
SELECT user_id, round(sum(value) / count(DISTINCT CAST(ts AS DATE)), 6) AS per_active_day, round(sum(value) / 30, 6) AS per_requested_day,
  round(sum(value) / count(DISTINCT CAST(ts AS DATE)) * 30, 6) AS forecast_30d
FROM {{events}} WHERE ts >= {AS_OF} - INTERVAL 30 DAY GROUP BY user_id
""",
)
add(
    "metrics_last_windows",
    f"""
SELECT count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOUR) AS last_day,
  count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 7 DAY) AS last_week, count(DISTINCT user_id) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOUR) AS users_day
FROM {{events}}
""",
)

# documents and products ------------------------------------------------------------------------

add("unused_documents_anti", "SELECT d.doc_id, d.source, d.n_chars FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
add("eligible_semi", "SELECT d.doc_id, d.lang FROM {documents} d WHERE d.doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1)")
add("document_formats_share", "SELECT doc_id % 4 AS format, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM {documents} GROUP BY doc_id % 4")
add(
    "string_agg_distinct",
    "SELECT p_brand, coalesce(nullif(array_join(array_sort(collect_set(p_type)), ', '), ''), 'other') AS types FROM {part} GROUP BY p_brand",
    "SELECT p_brand, coalesce(nullif(string_agg(DISTINCT p_type, ', ' ORDER BY p_type), ''), 'other') AS types FROM part GROUP BY p_brand",
)
add(
    "array_agg_sorted",
    "SELECT source, array_join(array_sort(collect_set(lang)), '|') AS langs, count(*) AS n FROM {documents} GROUP BY source",
    "SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, count(*) AS n FROM documents GROUP BY source",
)
add(
    "product_list_status",
    """
SELECT c.c_custkey, c.c_name, coalesce(o.total, 0) AS total, coalesce(o.ready, 0) AS ready, coalesce(o.pending, 0) AS pending, coalesce(o.failed, 0) AS failed
FROM {customer} c LEFT JOIN (
  SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready,
    count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed
  FROM {orders} GROUP BY o_custkey
) o ON o.o_custkey = c.c_custkey
""",
)
add(
    "tenant_dimension_join",
    """
SELECT r.r_name, n.n_name, count(*) AS customers, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS charge
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY r.r_name, n.n_name
""",
)
add("correlated_key_count", "SELECT s.s_suppkey, (SELECT count(*) FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey) AS keys FROM {supplier} s")
add("exists_any_document", "SELECT EXISTS (SELECT 1 FROM {documents} WHERE lang = 'en') AS has_documents, EXISTS (SELECT 1 FROM {documents} WHERE lang = 'xx') AS has_other")
add("paginated_search", "SELECT c_custkey, c_name, c_mktsegment FROM {customer} WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%auto%' ORDER BY c_custkey LIMIT 20 OFFSET 20")
add("document_token_stats", "SELECT source, count(*) AS chunks, sum(n_chars) AS chars, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 1) AS mean FROM {documents} GROUP BY source", "SELECT source, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 1) AS mean FROM documents GROUP BY source")
add("fuzzy_join_role", "SELECT a.conv_id, a.turn, length(a.text) AS answer_chars, length(u.text) AS question_chars FROM {conversations} a LEFT JOIN {conversations} u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'")

# sessions --------------------------------------------------------------------------------------

add("avg_messages_per_session", "SELECT round(avg(n), 4) AS avg_messages, count(*) AS sessions, max(n) AS longest FROM (SELECT conv_id, count(*) AS n FROM {conversations} GROUP BY conv_id) t")
add(
    "session_cost_rollup",
    """
SELECT m.conv_id, m.messages, coalesce(a.total, 0) AS total FROM (SELECT conv_id, count(*) AS messages FROM {conversations} GROUP BY conv_id) m
LEFT JOIN (SELECT user_id, round(sum(value), 2) AS total FROM {events} GROUP BY user_id) a ON a.user_id = m.conv_id
""",
)
add(
    "session_cost_fanout",
    """
SELECT m.conv_id, count(DISTINCT m.turn) AS messages, round(coalesce(sum(e.value), 0), 2) AS total
FROM {conversations} m LEFT JOIN {events} e ON e.user_id = m.conv_id GROUP BY m.conv_id
""",
)
add("last_user_message_lexical", "SELECT conv_id, max(text) FILTER (WHERE role = 'user') AS preview FROM {conversations} GROUP BY conv_id")
add(
    "last_message_latest",
    "SELECT conv_id, max_by(text, turn) AS preview, max(turn) AS turn FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id, arg_max(text, turn) AS preview, max(turn) AS turn FROM conversations GROUP BY conv_id",
)
add(
    "budget_prefix_fill",
    """
SELECT conv_id, turn, cost, used FROM (
  SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM (
    SELECT conv_id, turn, CAST(least(300, greatest(1, floor(length(text) / 4))) AS BIGINT) AS cost FROM {conversations}) c) t
WHERE used <= 500
""",
    """
SELECT conv_id, turn, cost, CAST(used AS BIGINT) AS used FROM (
  SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM (
    SELECT conv_id, turn, CAST(least(300, greatest(1, floor(length(text) / 4))) AS BIGINT) AS cost FROM conversations) c) t
WHERE used <= 500
""",
)
add(
    "history_window",
    """
SELECT conv_id, turn, role FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest,
    sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4)) END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
  FROM {conversations}) t WHERE newest <= 6 AND used <= 400
""",
)
add("latest_per_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) t WHERE rn = 1")
add("row_number_versions", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM {orders}")
add("outline_distinct", "SELECT source, lang, min(doc_id) AS first_doc FROM {documents} GROUP BY source, lang ORDER BY first_doc, source, lang")
add(
    "qa_pairs_sampled",
    """
SELECT d.doc_id, d.lang, l.quality FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
ORDER BY CASE WHEN l.quality IS NOT NULL THEN 0 ELSE 1 END, d.doc_id LIMIT 50
""",
)

# billing ---------------------------------------------------------------------------------------

#: USD for a million tokens, in and out, as cost and as charge: fixed values
RATES = """
  SELECT 'gemini-2.5-flash' AS model, 0.30 AS cogs_in, 2.50 AS cogs_out, 0.50 AS charge_in, 4.00 AS charge_out
  UNION ALL SELECT 'gemini-2.5-flash-lite', 0.15, 1.25, 0.25, 2.00
  UNION ALL SELECT 'gemini-2.5-pro', 1.25, 10.00, 2.50, 20.00
  UNION ALL SELECT 'gemini-2.0-flash', 0.10, 0.40, 0.20, 0.80
"""
add(
    "llm_cost_decimal",
    f"""
WITH rates AS ({RATES}), calls AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'gemini-2.5-flash' WHEN 1 THEN 'gemini-2.5-flash-lite' WHEN 2 THEN 'gemini-2.5-pro' WHEN 3 THEN 'gemini-2.0-flash' ELSE 'unknown' END AS model,
    CAST(l_quantity * 100 AS BIGINT) AS tokens_in, CAST(l_quantity * 7 AS BIGINT) AS tokens_out FROM {{lineitem}}
)
SELECT c.model, count(*) AS calls,
  CAST(sum(coalesce(CAST(c.tokens_in * CAST(r.cogs_in AS DECIMAL(8, 2)) * CAST(0.000001 AS DECIMAL(7, 6)) + c.tokens_out * CAST(r.cogs_out AS DECIMAL(8, 2)) * CAST(0.000001 AS DECIMAL(7, 6)) AS DECIMAL(20, 8)), 0)) AS DECIMAL(22, 8)) AS cogs_usd,
  CAST(sum(coalesce(CAST(c.tokens_in * CAST(r.charge_in AS DECIMAL(8, 2)) * CAST(0.000001 AS DECIMAL(7, 6)) + c.tokens_out * CAST(r.charge_out AS DECIMAL(8, 2)) * CAST(0.000001 AS DECIMAL(7, 6)) AS DECIMAL(20, 8)), 0)) AS DECIMAL(22, 8)) AS charge_usd
FROM calls c LEFT JOIN rates r ON r.model = c.model GROUP BY c.model
""",
)
add(
    "cost_attribution_share",
    """
SELECT e.event_id, e.user_id, round(e.value / t.total, 8) AS share, round(0.5 * e.value / t.total, 8) AS charge FROM {events} e
JOIN (SELECT user_id, sum(value) AS total FROM {events} WHERE value > 0 GROUP BY user_id) t ON t.user_id = e.user_id WHERE e.value > 0
""",
)
add(
    "usage_unpivot_steps",
    """
SELECT o_orderkey, step, tokens FROM (
  SELECT o_orderkey, 'embed' AS step, CAST(floor(o_totalprice / 1000) AS BIGINT) AS tokens FROM {orders}
  UNION ALL SELECT o_orderkey, 'extract', CAST(floor(o_totalprice / 50000) AS BIGINT) FROM {orders}
  UNION ALL SELECT o_orderkey, 'ocr', CAST(floor(o_totalprice / 200000) AS BIGINT) FROM {orders}) t WHERE tokens > 0
""",
)

# text lookups ----------------------------------------------------------------------------------

add(
    "grep_snippets",
    """
SELECT doc_id, pos, substr(text, greatest(1, pos - 120), 240 + length('license')) AS snippet,
  CASE WHEN pos > 121 THEN 1 ELSE 0 END AS cut_left FROM (
  SELECT doc_id, text, CAST(instr(lower(text), 'license') AS BIGINT) AS pos FROM {documents}) t WHERE pos > 0 ORDER BY doc_id LIMIT 30
""",
)
add(
    "token_estimates",
    r"""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) END AS by_chars,
  CASE WHEN trim(text) = '' THEN 1 ELSE CAST(greatest(1, floor(size(split(trim(text), '[ \\n\\t\\r]+')) * 1.3)) AS BIGINT) END AS by_words FROM {documents}
""",
    r"""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) END AS by_chars,
  CASE WHEN trim(text) = '' THEN 1 ELSE CAST(greatest(1, floor(len(regexp_split_to_array(trim(text), '[ \n\t\r]+')) * 1.3)) AS BIGINT) END AS by_words FROM documents
""",
)
add("slug_products", "SELECT p_partkey, lower(regexp_replace(trim(p_name), '[^A-Za-z0-9]+', '-')) AS slug FROM {part}", "SELECT p_partkey, lower(regexp_replace(trim(p_name), '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM part")
add("normalised_name_match", "SELECT p_partkey, p_name FROM {part} WHERE replace(replace(replace(lower(p_name), ' ', ''), '-', ''), '_', '') LIKE '%redw%'")
add("content_hashes", "SELECT doc_id, sha2(text, 256) AS hash, substr(sha2(text, 256), 1, 12) AS short_hash FROM {documents}", "SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 12) AS short_hash FROM documents")
add(
    "dedup_keep_first_hash",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, sha2(text, 256) ORDER BY doc_id) AS rn FROM {documents}) t WHERE rn = 1",
    "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS rn FROM documents) t WHERE rn = 1",
)
add(
    "endpoint_normalise",
    r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/[0-9]+', '/{{id}}')) AS endpoint FROM {pages}",
    r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/[0-9]+', '/{id}', 'g')) AS endpoint FROM pages",
)

# windows over time and maintenance -----------------------------------------------------------------

_W = "date_trunc('hour', ts)"
add("window_count_1h", f"SELECT {_W} AS bucket, count(*) AS n FROM {{events}} GROUP BY {_W}")
add("window_by_label", f"SELECT {_W} AS bucket, event_type, count(*) AS n FROM {{events}} GROUP BY {_W}, event_type")
add("window_avg_max", f"SELECT {_W} AS bucket, round(avg(value), 4) AS mean, max(value) AS most, round(sum(value), 4) AS total FROM {{events}} GROUP BY {_W}")
add("window_quantile", f"SELECT {_W} AS bucket, round(percentile(value, 0.95), 6) AS p95 FROM {{events}} GROUP BY {_W}", f"SELECT {_W} AS bucket, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY {_W}")
add("window_last", f"SELECT {_W} AS bucket, max_by(value, event_id) AS last_value FROM {{events}} GROUP BY {_W}", f"SELECT {_W} AS bucket, arg_max(value, event_id) AS last_value FROM events GROUP BY {_W}")
add(
    "window_topk",
    f"""
SELECT bucket, user_id, n FROM (SELECT bucket, user_id, n, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, user_id) AS rn FROM (
  SELECT CAST(ts AS DATE) AS bucket, user_id, count(*) AS n FROM {{events}} GROUP BY CAST(ts AS DATE), user_id) c) t WHERE rn <= 10
""",
)
add(
    "window_absent",
    f"""
SELECT h.bucket FROM (SELECT explode(sequence(a, b, INTERVAL 1 HOUR)) AS bucket FROM (SELECT min({_W}) AS a, max({_W}) AS b FROM {{events}}) r) h
LEFT ANTI JOIN (SELECT DISTINCT {_W} AS bucket FROM {{events}} WHERE event_type = 'error') s ON s.bucket = h.bucket
""",
    f"""
SELECT h.bucket FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS bucket FROM (SELECT min({_W}) AS a, max({_W}) AS b FROM events) r) h
WHERE h.bucket NOT IN (SELECT {_W} FROM events WHERE event_type = 'error')
""",
)
add("error_rate_ratio", f"SELECT {_W} AS bucket, round(100e0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_pct FROM {{events}} GROUP BY {_W}")
add(
    "alert_firing",
    """
WITH w AS (
  SELECT CAST(ts AS DATE) AS day, 100e0 * count(*) FILTER (WHERE event_type = 'error') / count(*) AS pct FROM {events} GROUP BY CAST(ts AS DATE)
), marked AS (
  SELECT day, pct > 19 AS breached, row_number() OVER (ORDER BY day) - row_number() OVER (PARTITION BY pct > 19 ORDER BY day) AS island FROM w
)
SELECT day, row_number() OVER (PARTITION BY island, breached ORDER BY day) AS held,
  CASE WHEN NOT breached THEN 'ok' WHEN row_number() OVER (PARTITION BY island, breached ORDER BY day) > 2 THEN 'firing' ELSE 'pending' END AS state
FROM marked
""",
)
add(
    "counter_rate",
    """
SELECT user_id, event_id, round(CASE WHEN previous IS NULL THEN 0 WHEN value < previous THEN value ELSE value - previous END, 6) AS increase FROM (
  SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}) t
""",
)
add(
    "stale_documents",
    f"SELECT user_id, max(ts) AS progress, CASE WHEN count(*) >= 70 THEN 'error' ELSE 'retry' END AS next_status FROM {{events}} GROUP BY user_id HAVING max(ts) < {AS_OF} - INTERVAL 45 MINUTE",
)
add("heartbeat_stale", f"SELECT user_id, max(ts) < {AS_OF} - INTERVAL 24 HOUR AS is_stale FROM {{events}} GROUP BY user_id")
add("expiry_sweep", f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'expired' ELSE o_orderstatus END AS next_status FROM {{orders}}")
add("upsert_by_key", "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, 0) AS quality, n.doc_id IS NULL AS inserted FROM {labels} n FULL OUTER JOIN {documents} o ON n.doc_id = o.doc_id")
add("log_lines_filtered", "SELECT event_id, user_id, value FROM {events} WHERE event_type = 'error' AND props LIKE '%1%' ORDER BY ts DESC, event_id DESC LIMIT 100")
add("grouping_sets_usage", "SELECT event_type, user_id % 5 AS team, count(*) AS n FROM {events} GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())", "SELECT event_type, team, count(*) AS n FROM (SELECT event_type, user_id % 5 AS team FROM events) t GROUP BY GROUPING SETS ((event_type), (team), ())")
add(
    "chunk_median_upper",
    """
SELECT lang, min(n_chars) AS upper_median FROM (
  SELECT lang, n_chars, sum(n) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY lang) AS whole FROM (
    SELECT lang, n_chars, count(*) AS n FROM {documents} WHERE n_chars IS NOT NULL GROUP BY lang, n_chars) c) t
WHERE upto > floor(whole / 2) GROUP BY lang
""",
    "SELECT lang, max(n_chars) FILTER (WHERE rn = n // 2 + 1) AS upper_median FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) t GROUP BY lang",
)
