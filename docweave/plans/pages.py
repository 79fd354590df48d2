"""More pages, appended records, lifecycle batches and windows, as SQL over the tables.

The same conventions as in analytics: one statement for both engines where they agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.numbering import numbered
from docweave.plans.analytics import AS_OF, STATEMENTS, add
from docweave.tables import met, plain, run_sql, table

# pages ---------------------------------------------------------------------------------------------

_CHANNELS = ("click", "view", "purchase", "error")
add(
    "platform_overview_full",
    f"""
SELECT t.*, u.* FROM (SELECT (SELECT count(*) FROM {{documents}}) AS documents, (SELECT count(*) FROM {{documents}} WHERE n_chars > 0) AS documents_ready,
  (SELECT count(*) FROM {{documents}} WHERE text IS NULL) AS documents_failed, (SELECT count(*) FROM {{embeddings}}) AS chunks, (SELECT count(*) FROM {{customer}}) AS tenants,
  (SELECT count(*) FROM {{customer}} WHERE c_acctbal > 0) AS tenants_active, (SELECT count(*) FROM {{part}}) AS products, (SELECT count(DISTINCT conv_id) FROM {{conversations}}) AS sessions,
  (SELECT count(*) FROM {{conversations}}) AS messages, (SELECT count(*) FROM {{supplier}}) AS api_keys) t
CROSS JOIN (SELECT count(*) AS calls, count(DISTINCT user_id) AS users, round(coalesce(sum(value), 0), 2) AS total, round(coalesce(avg(value), 0), 4) AS mean,
  {", ".join(f"count(*) FILTER (WHERE event_type = '{c}') AS {c}_calls, round(coalesce(sum(value) FILTER (WHERE event_type = '{c}'), 0), 2) AS {c}_total" for c in _CHANNELS)}
  FROM {{events}} WHERE ts >= {AS_OF} - INTERVAL 30 DAY) u
""",
)
add(
    "ingestion_stats",
    """
SELECT count(*) AS documents, count(*) FILTER (WHERE n_chars >= 200) AS ready, count(*) FILTER (WHERE n_chars < 200) AS failed, round(100e0 * count(*) FILTER (WHERE n_chars < 200) / count(*), 1) AS failed_pct,
  round(avg(n_chars), 1) AS mean_chars, max(n_chars) AS most_chars, count(DISTINCT source) AS sources, round(sum(n_chars) / 1048576e0, 3) AS megabytes FROM {documents}
""",
)
add(
    "chat_stats",
    """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS answers, count(DISTINCT user_id) AS users, round(avg(value), 2) AS mean_ms, count(*) FILTER (WHERE event_type = 'error') AS errors,
    count(*) FILTER (WHERE event_type = 'purchase') AS positive, count(*) FILTER (WHERE event_type = 'click') AS negative FROM {events} GROUP BY CAST(ts AS DATE))
SELECT day, answers, users, mean_ms, round(100e0 * errors / answers, 1) AS error_pct, CASE WHEN positive + negative = 0 THEN NULL ELSE round(100e0 * positive / (positive + negative), 1) END AS positive_pct,
  CAST(sum(answers) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS answers_so_far FROM d
""",
)
add("question_kind_share", "SELECT role, n, round(100e0 * n / sum(n) OVER (), 1) AS pct FROM (SELECT role, count(*) AS n FROM {conversations} GROUP BY role) t")
add(
    "document_stats",
    """
SELECT source, documents, chars, used, pos FROM (
  SELECT d.source, count(*) AS documents, CAST(sum(d.n_chars) AS BIGINT) AS chars, count(l.doc_id) AS used, row_number() OVER (ORDER BY count(*) DESC, sum(d.n_chars) DESC, d.source) AS pos
  FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON l.doc_id = d.doc_id GROUP BY d.source) s WHERE pos <= 10
""",
)
add("document_uploads_daily", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS uploads, count(DISTINCT o_custkey) AS tenants FROM {orders} GROUP BY CAST(o_orderdate AS DATE)")
add(
    "cost_stats",
    f"""
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS channel, user_id AS api_key, value FROM {{events}} WHERE ts >= {AS_OF} - INTERVAL 30 DAY)
SELECT 'total' AS part, 'all' AS name, round(sum(value), 2) AS cost FROM e UNION ALL SELECT 'channel', channel, round(sum(value), 2) FROM e GROUP BY channel
UNION ALL SELECT 'day', CAST(day AS VARCHAR(10)), round(sum(value), 2) FROM e GROUP BY day
UNION ALL SELECT 'key', CAST(api_key AS VARCHAR(20)), cost FROM (SELECT api_key, round(sum(value), 2) AS cost, row_number() OVER (ORDER BY round(sum(value), 2) DESC, api_key) AS pos FROM e GROUP BY api_key) k WHERE pos <= 5
UNION ALL SELECT 'forecast', 'month', round(30 * sum(value) / count(DISTINCT day), 2) FROM e
""",
)
add(
    "tenant_activity",
    """
SELECT c.c_custkey AS tenant, count(*) AS calls, count(DISTINCT CAST(e.ts AS DATE)) AS days, round(sum(e.value), 2) AS cost, count(*) FILTER (WHERE e.event_type = 'error') AS errors
FROM {events} e JOIN {customer} c ON c.c_custkey = e.user_id WHERE c.c_mktsegment = 'BUILDING' GROUP BY c.c_custkey
""",
)
add(
    "product_debug_full",
    """
SELECT p.p_partkey, p.p_name, count(l.l_orderkey) AS chunks, count(DISTINCT l.l_orderkey) AS documents, count(DISTINCT l.l_suppkey) AS sources, coalesce(sum(l.l_quantity), 0) AS tokens, min(l.l_quantity) AS least, max(l.l_quantity) AS most,
  round(avg(l.l_quantity), 1) AS mean, count(*) FILTER (WHERE l.l_returnflag = 'A') AS returned, count(*) FILTER (WHERE l.l_returnflag = 'N') AS fresh, count(*) FILTER (WHERE l.l_returnflag = 'R') AS rejected,
  count(*) FILTER (WHERE l.l_linestatus = 'O') AS open, count(*) FILTER (WHERE l.l_linestatus = 'F') AS closed, min(l.l_shipdate) AS first_seen, max(l.l_shipdate) AS last_seen,
  round(coalesce(sum(l.l_extendedprice), 0), 2) AS cost, round(100e0 * count(*) FILTER (WHERE l.l_discount > 0.05) / greatest(1, count(l.l_orderkey)), 1) AS cheap_pct, count(DISTINCT l.l_shipdate) AS days, count(DISTINCT l.l_linenumber) AS positions
FROM {part} p LEFT JOIN {lineitem} l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey, p.p_name
""",
)
add(
    "session_list",
    """
SELECT conv_id, messages, first_words, last_role FROM (
  SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS messages, substr(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 1, 100) AS first_words, role AS last_role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM {conversations}) t WHERE rn = 1
""",
)
add(
    "document_debug",
    """
SELECT d.doc_id, d.source, d.lang, d.n_chars, p.p_name AS product, coalesce(k.search_keys, 0) AS search_keys FROM {documents} d LEFT JOIN {part} p ON p.p_partkey = d.doc_id
LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS search_keys FROM {lineitem} GROUP BY l_partkey) k ON k.l_partkey = d.doc_id
""",
)
add("document_list", "SELECT doc_id, source, lang, n_chars FROM {documents} WHERE source = 'src1' ORDER BY doc_id DESC LIMIT 200")
add(
    "evaluation_runs",
    """
SELECT run, day, mrr, total, run = latest AS is_latest FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) OVER () AS total, row_number() OVER (ORDER BY CAST(ts AS DATE)) AS run, max(rn) OVER () AS latest, mrr FROM (
    SELECT ts, row_number() OVER (ORDER BY ts) AS rn, mrr FROM (SELECT CAST(ts AS DATE) AS ts, round(avg(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END), 4) AS mrr FROM {events} GROUP BY CAST(ts AS DATE)) g) n) r
ORDER BY day DESC LIMIT 20
""",
)
add("tenant_autocomplete", "SELECT c_custkey, c_name FROM {customer} WHERE c_name ILIKE '%00001%' ORDER BY c_name LIMIT 10")
add(
    "product_info",
    """
SELECT p.p_partkey, p.p_brand, count(DISTINCT l.l_orderkey) AS documents, count(l.l_orderkey) AS chunks, count(DISTINCT l.l_shipdate) AS versions, b.of_brand
FROM {part} p JOIN (SELECT p_brand, count(*) AS of_brand FROM {part} GROUP BY p_brand) b ON b.p_brand = p.p_brand LEFT JOIN {lineitem} l ON l.l_partkey = p.p_partkey GROUP BY p.p_partkey, p.p_brand, b.of_brand
""",
)
_LIFECYCLE = "SELECT o_custkey AS product, o_orderkey AS document, o_orderdate AS seen, o_orderstatus AS status, o_totalprice AS score FROM {orders}"
add(
    "lifecycle_lookup",
    f"""
WITH r AS ({_LIFECYCLE}), merged AS (SELECT product, max(document) AS document FROM r WHERE status = 'F' GROUP BY product),
latest AS (SELECT product, document FROM (SELECT product, document, row_number() OVER (PARTITION BY product ORDER BY seen DESC, document DESC) AS rn FROM r) t WHERE rn = 1)
SELECT l.product, coalesce(m.document, l.document) AS document, m.document IS NOT NULL AS is_merged, CASE WHEN r.score >= 200000 THEN 'GOOD' WHEN r.score >= 100000 THEN 'PARTIAL' ELSE 'LOW' END AS quality
FROM latest l LEFT JOIN merged m ON m.product = l.product JOIN r ON r.document = coalesce(m.document, l.document)
""",
)
add(
    "lifecycle_page",
    f"""
WITH r AS ({_LIFECYCLE}), u AS (SELECT l_orderkey, count(*) AS issues, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM {{lineitem}} GROUP BY l_orderkey)
SELECT r.product, count(*) AS documents, count(*) FILTER (WHERE r.status = 'F') AS ready, CAST(coalesce(sum(u.issues), 0) AS BIGINT) AS issues, CAST(coalesce(sum(u.tokens), 0) AS BIGINT) AS tokens, max(r.seen) AS updated
FROM r LEFT JOIN u ON u.l_orderkey = r.document GROUP BY r.product
""",
)
add(
    "lifecycle_prefix",
    """
SELECT h.l_partkey AS product, concat('--- API Integration Context (', p.p_name, ') ---', chr(10), w.warnings, chr(10), '---') AS prefix FROM (SELECT DISTINCT l_partkey FROM {lineitem}) h
JOIN {part} p ON p.p_partkey = h.l_partkey JOIN (
  SELECT l_partkey, string_agg(concat('WARNING: order ', CAST(l_orderkey AS VARCHAR(12))), chr(10)) AS warnings FROM (
    SELECT l_partkey, l_orderkey FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM {lineitem}) n WHERE rn = 1) f GROUP BY l_partkey) w ON w.l_partkey = h.l_partkey
""",
)

# predicates, paging and sets --------------------------------------------------------------------------

add("rerank_threshold", "SELECT event_id, value FROM {events} WHERE CASE WHEN event_type = 'view' THEN value / 100e0 >= 0.3 ELSE value / 100e0 >= 0.35 END")
add(
    "scope_conflicts",  # two candidates a scope are enough: the smallest, and the next for the row that is the smallest itself
    """
WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS scope FROM {orders} WHERE o_orderstatus = 'P'),
least_two AS (
  SELECT scope, min(CASE WHEN n = 1 THEN o_orderkey END) AS k1, min(CASE WHEN n = 2 THEN o_orderkey END) AS k2 FROM (
    SELECT scope, o_orderkey, row_number() OVER (PARTITION BY scope ORDER BY o_orderkey) AS n FROM p WHERE scope IS NOT NULL) r WHERE n <= 2 GROUP BY scope
), everywhere AS (
  SELECT min(o_orderkey) AS k1, min(CASE WHEN o_orderkey > (SELECT min(o_orderkey) FROM p WHERE scope IS NULL) THEN o_orderkey END) AS k2 FROM p WHERE scope IS NULL
)
SELECT wanted, least(coalesce(own, others), coalesce(others, own)) AS conflicting FROM (
  SELECT a.o_orderkey AS wanted, CASE WHEN s.k1 = a.o_orderkey THEN s.k2 ELSE s.k1 END AS own, CASE WHEN e.k1 = a.o_orderkey THEN e.k2 ELSE e.k1 END AS others
  FROM p a LEFT JOIN least_two s ON s.scope = a.o_custkey CROSS JOIN everywhere e) c WHERE coalesce(own, others) IS NOT NULL""",
    plain(
        "SELECT a.o_orderkey AS wanted, min(b.o_orderkey) AS conflicting FROM {orders} a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS scope FROM {orders} WHERE o_orderstatus = 'P') b ON b.scope = a.o_custkey OR b.scope IS NULL WHERE a.o_orderstatus = 'P' AND b.o_orderkey <> a.o_orderkey GROUP BY a.o_orderkey"
    ),
)
add("dimension_filter_join", "SELECT e.event_type, count(*) AS n, round(sum(e.value), 2) AS total FROM {events} e JOIN {customer} c ON c.c_custkey = e.user_id JOIN {nation} n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1 GROUP BY e.event_type")
add("keyset_page", "SELECT doc_id, source FROM {documents} WHERE doc_id > 57 ORDER BY doc_id LIMIT 50")
KEYSET_SQL = plain(
    "SELECT batch, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100e0) AS BIGINT) AS batch FROM {documents}) b GROUP BY batch"
)


def q_keyset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return rows.groupBy(F.floor(F.col("number") / 100).cast("long").alias("batch")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


add("random_sample", "SELECT doc_id, rated FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS rated, md5(concat('seed-7-', CAST(d.doc_id AS VARCHAR(20)))) AS draw FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id) s ORDER BY CASE WHEN rated THEN 0 ELSE 1 END, draw LIMIT 40")
LISTS_SQL = plain(
    "SELECT event_id, origin, row_number() OVER (ORDER BY list, pos) AS pos FROM (SELECT event_id, 'hit' AS origin, 0 AS list, row_number() OVER (ORDER BY value DESC, event_id) AS pos FROM {events} WHERE event_type = 'view' AND value > 90 UNION ALL SELECT event_id, 'related', 1, row_number() OVER (ORDER BY value DESC, event_id) FROM {events} WHERE event_type = 'click' AND value > 90) u"
)


def q_list_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, then related ones, each list by value."""
    events = table(spark, sf_dir, "events").where("event_type IN ('view', 'click') AND value > 90")
    rows = events.select("event_id", "value", F.when(F.col("event_type") == "view", "hit").otherwise("related").alias("origin"))
    return numbered(rows, ["origin", F.desc("value"), "event_id"]).select("event_id", "origin", (F.col("number") + 1).alias("pos"))


add("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM {orders} UNION SELECT c_custkey FROM {customer}) u UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0) i UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders}) e")
add("window_frames", "SELECT event_id, lag(value, 1, 0e0) OVER w AS before, lead(value) OVER w AS after, ntile(4) OVER w AS quarter, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_of_three FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
add("usage_cube", "SELECT event_type, team, count(*) AS n, grouping(event_type) AS all_types, grouping(team) AS all_teams FROM (SELECT event_type, user_id % 5 AS team FROM {events}) t GROUP BY CUBE (event_type, team) HAVING count(*) > 10")
add("usage_rollup", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY ROLLUP (lang, source)")
add("approximate_distinct", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.15e0 * count(DISTINCT user_id) AS close FROM {events} GROUP BY event_type")

# appended records ---------------------------------------------------------------------------------------

add(
    "usage_log_default_costs",
    """
SELECT event_id, channel, action, CAST(CASE WHEN value < 5 THEN 0.5 WHEN channel = 'chat' THEN CAST(floor(value) AS BIGINT) * 0.0000003 + 7 * 0.0000025 WHEN action IN ('search_documentation', 'get_api_endpoint') THEN 0.0001 ELSE 0 END AS DECIMAL(14, 8)) AS cogs_usd,
  CAST(floor(value) AS BIGINT) + 7 AS total_tokens FROM (
  SELECT event_id, value, CASE event_type WHEN 'click' THEN 'chat' ELSE 'mcp' END AS channel, CASE event_type WHEN 'view' THEN 'search_documentation' WHEN 'error' THEN 'get_api_endpoint' WHEN 'click' THEN 'answer' ELSE 'list_products' END AS action FROM {events}) e
""",
)
_STEPS = ["classify", "rewrite", "embed", "search", "rerank", "expand", "answer", "continue", "judge", "summarise"]
_USED = {s: f"CAST(floor(length(text) * {k + 1} / 100e0) AS BIGINT) - {3 * k}" for k, s in enumerate(_STEPS)}
add(
    "chat_usage_rows",
    f"SELECT * FROM (SELECT conv_id, turn, stack({len(_USED)}, {', '.join(f"'{s}', {x}" for s, x in _USED.items())}) AS (action, tokens) FROM {{conversations}} WHERE role = 'assistant') u WHERE tokens > 0",
    "SELECT conv_id, turn, action, tokens FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{s}' AS action, CAST(floor(length(text) * {k + 1} / 100e0) AS BIGINT) - {3 * k} AS tokens FROM conversations WHERE role = 'assistant'" for k, s in enumerate(_STEPS)) + ") u WHERE tokens > 0",
)
add("analytics_append", "SELECT event_id, event_type, 'stored' AS origin FROM {events} UNION ALL SELECT conv_id * 1000 + turn, role, 'new' FROM {conversations} WHERE role = 'user'")
add(
    "shared_snapshot",
    "SELECT conv_id, substr(sha2(concat('share-', CAST(conv_id AS STRING)), 256), 1, 16) AS token, to_json(array_sort(collect_list(struct(turn, role, length(text) AS chars)))) AS payload FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id, substr(sha256('share-' || conv_id), 1, 16) AS token, CAST(to_json(list({'turn': turn, 'role': role, 'chars': length(text)} ORDER BY turn, role, length(text))) AS VARCHAR) AS payload FROM conversations GROUP BY conv_id",
)
add("replace_by_name", "SELECT p_partkey, p_name, is_new FROM (SELECT p_partkey, p_name, is_new, row_number() OVER (PARTITION BY p_name ORDER BY is_new DESC, p_partkey DESC) AS rn FROM (SELECT p_partkey, p_name, 0 AS is_new FROM {part} UNION ALL SELECT p_partkey + 1000000, p_name, 1 FROM {part} WHERE p_partkey % 10 = 0) u) r WHERE rn = 1")
add("product_get_or_create", "SELECT name, brand, min(is_new) AS created FROM (SELECT lower(p_name) AS name, p_brand AS brand, 0 AS is_new FROM {part} UNION ALL SELECT lower(concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE '' END)), p_brand, 1 FROM {part}) u GROUP BY name, brand")
add("search_key_upkeep", "SELECT d.doc_id, lower(d.source) AS search_key FROM {documents} d WHERE d.source IS NOT NULL UNION SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END FROM {labels} l")
add(
    "crawl_page_actions",
    "SELECT n.doc_id, CASE WHEN coalesce(length(trim(n.text)), 0) = 0 THEN 'skip empty' WHEN o.h = n.h THEN 'skip same' WHEN o.doc_id IS NOT NULL THEN 'replace' ELSE 'insert' END AS step FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS text, md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS h FROM {documents}) n LEFT JOIN (SELECT doc_id, md5(text) AS h FROM {documents} WHERE doc_id % 4 <> 1) o ON o.doc_id = n.doc_id",
)
add("counters_update", "SELECT p.p_partkey, p.p_size + coalesce(d.documents, 0) AS documents, coalesce(d.chunks, 0) AS chunks FROM {part} p LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS documents, count(*) AS chunks FROM {lineitem} GROUP BY l_partkey) d ON d.l_partkey = p.p_partkey")
add(
    "product_delete_cascade",
    """
WITH gone AS (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING'), kept AS (SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.c_custkey = o.o_custkey))
SELECT 'customer' AS tab, count(*) AS n FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.c_custkey = c.c_custkey) UNION ALL SELECT 'orders', count(*) FROM kept
UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} l WHERE EXISTS (SELECT 1 FROM kept k WHERE k.o_orderkey = l.l_orderkey)
""",
)

# windows ---------------------------------------------------------------------------------------------------

add(
    "window_quantiles",
    "SELECT date_trunc('hour', ts) AS bucket, round(q[0], 6) AS p50, round(q[1], 6) AS p95, round(q[2], 6) AS p99 FROM (SELECT ts, percentile(value, array(0.5, 0.95, 0.99)) AS q FROM (SELECT date_trunc('hour', ts) AS ts, value FROM {events}) h GROUP BY ts) w",
    "SELECT date_trunc('hour', ts) AS bucket, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
)
add(
    "counter_rate_windows",
    """
SELECT user_id, bucket, round(sum(increase) / 86400e0, 9) AS per_second FROM (
  SELECT user_id, date_trunc('day', ts) AS bucket, CASE WHEN previous IS NULL THEN 0 WHEN value < previous THEN value ELSE value - previous END AS increase FROM (
    SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}) t) i GROUP BY user_id, bucket
""",
)
add(
    "log_pipeline",
    "SELECT event_id, concat(event_type, ' ', get_json_object(props, '$.k')) AS line FROM {events} WHERE regexp_like(props, '\"k\": ?[0-9]*[13579]') AND event_type IN ('error', 'view') AND CAST(get_json_object(props, '$.k') AS DOUBLE) > 20",
    "SELECT event_id, event_type || ' ' || json_extract_string(props, '$.k') AS line FROM events WHERE regexp_matches(props, '\"k\": ?[0-9]*[13579]') AND event_type IN ('error', 'view') AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 20",
)
add(
    "partition_roll_forward",
    "SELECT concat('usage_', date_format(m, 'yyyy_MM')) AS partition, m AS first_day, add_months(m, 1) AS end_day FROM (SELECT explode(sequence(d, add_months(d, 2), INTERVAL 1 MONTH)) AS m FROM (SELECT CAST(date_trunc('month', max(ts)) AS DATE) AS d FROM {events}) x) y",
    "SELECT 'usage_' || strftime(m, '%Y_%m') AS partition, CAST(m AS DATE) AS first_day, CAST(m + INTERVAL 1 MONTH AS DATE) AS end_day FROM (SELECT unnest(generate_series(d, d + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS m FROM (SELECT date_trunc('month', max(ts)) AS d FROM events) x) y",
)


def _debugged(key: str):
    """The statement over parts and lines that meet in tasks of so many rows.

    Distinct values are counted as sets: for several counts Spark would repeat each line and deal them all again.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = re.sub(r"count\(DISTINCT ([\w.]+)\)", r"CAST(size(collect_set(\1)) AS BIGINT)", STATEMENTS[key].sql)
        return run_sql(spark, sf_dir, sql, **met(part=(table(spark, sf_dir, "part"), "p_partkey"), lineitem=(table(spark, sf_dir, "lineitem"), "l_partkey")))

    return run


QUERIES = {"keyset_batches": q_keyset_batches, "list_concatenation": q_list_concatenation} | {k: _debugged(k) for k in ("product_debug", "product_debug_full")}
ORACLES = {"keyset_batches": KEYSET_SQL, "list_concatenation": LISTS_SQL} | {k: plain(STATEMENTS[k].sql) for k in ("product_debug", "product_debug_full")}
