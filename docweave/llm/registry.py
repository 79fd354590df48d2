"""The queries opN_*, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import ann, bpe, chat_template, embedding_neardup, hard_negatives, importance, language_id, line_dedup, packing, pii, simhash, substring_dedup, url_filter
from docweave.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, bytes_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM parts
), split AS (
  SELECT page_id,
    translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM hosts
), won AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM won
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.keeper) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL OR k.doc_id = c.keeper), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations and one more, -7; rows of that id in the table would be further turns of it."""
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    chats = chat_template.read_chats(chat_template.format_chats(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\\', '\\\\'), '<turn>', '\\<turn>'), '</role>', '\\</role>'), '</turn>', '\\</turn>') AS text_out,
    replace(replace(replace(replace(role, '\\', '\\\\'), '<turn>', '\\<turn>'), '</role>', '\\</role>'), '</turn>', '\\</turn>') AS role_out FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text_out) + length(role_out) + 21) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, own
"""


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = language_id.fold_of(F.col("doc_id"))
    prototypes = language_id.fit(docs.where(fold != 1))
    said = language_id.predict(docs.select("doc_id", "text"), prototypes)
    return said.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, wanted = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = importance.scores(docs, wanted, percent=10, ngram=1, buckets=10_000, min_words=20, seed="2024")
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 by its definition: a table from the polynomial, then byte by byte
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY byte) AS tab FROM steps WHERE k = 8
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark
), split AS (
  SELECT side, row, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), words AS (
  SELECT side, row, unnest(ws) AS w FROM split
), vocabulary AS (
  SELECT DISTINCT w FROM words
), hashed AS (
  SELECT w, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, tab[1 + (xor(c, b) & 255)]))) % 10000 AS bucket
  FROM vocabulary, crc_table
), bucketed AS (
  SELECT side, row, bucket FROM words JOIN hashed USING (w)
), totals AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM bucketed GROUP BY bucket
), sums AS (
  SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM totals
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS g FROM totals, sums
), weighed AS (
  SELECT row, count(*) AS n, sum(g)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
  SELECT s.row, id AS doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split s LEFT JOIN weighed w ON s.row = w.row WHERE side = 'd'
), placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (row)
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), width=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT row, doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS words FROM (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 11)) AS pos FROM rows WHERE doc_id IS NOT NULL)
), smallest AS (
  SELECT words, min(doc_id) AS least FROM windows GROUP BY words HAVING min(doc_id) < max(doc_id)
), covered AS (
  SELECT DISTINCT row, pos FROM (
    SELECT row, unnest(range(pos, pos + 13)) AS pos FROM windows JOIN smallest USING (words) WHERE least < doc_id
  )
), each AS (
  SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM rows
), kept AS (
  SELECT e.row, count(*) AS n_kept, string_agg(w, ' ' ORDER BY e.pos) AS text FROM each e ANTI JOIN covered c ON e.row = c.row AND e.pos = c.pos GROUP BY e.row
)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM rows LEFT JOIN kept ON rows.row = kept.row
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90, scale=256)


OP13_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, place FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) AS place FROM pairs WHERE same
  ) WHERE place <= 5
), negatives AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, place ORDER BY score DESC, vec_id, row) AS rank
  FROM positives p JOIN pairs n ON p.anchor = n.anchor AND NOT n.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_embedding_neardup,
            op2_simhash_neardup,
            op3_bpe_roundtrip,
            op4_url_filter,
            op5_packing,
            op6_line_dedup,
            op7_chat_format,
            op8_pii_spans,
            op9_ann_search,
            op10_language_id,
            op11_importance_resampling,
            op12_substring_dedup,
            op13_hard_negatives,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
