"""Records that are really written: usage and search logs, search keys, and converted pages beside their sources.

Each is a table of versioned slots (``slots``), so every write is one commit, a repeated run
changes nothing, and a run that fails before its end leaves what was there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.plans import pages  # noqa: F401  adds the statements of the logs
from docweave.plans.analytics import STATEMENTS
from docweave.scratch import shared_dir
from docweave.shipping import ship
from docweave.sources.html import tree_markdown
from docweave.sources.slots import Slots
from docweave.tables import plain, run_sql, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# logs: appended by runs ---------------------------------------------------------------------------------

USAGE = "event_id long, channel string, action string, cogs_usd decimal(14, 8), total_tokens long"


def with_default_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage records with the costs that rules give where none is known."""
    return run_sql(spark, sf_dir, STATEMENTS["usage_log_default_costs"].sql)


def q_usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records appended in two runs, of which one is tried twice."""
    log = Slots(spark, _folder(spark, "usage-log"), USAGE, "event_id")
    rows = with_default_costs(spark, sf_dir)
    halves = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1 OR event_id IS NULL")
    log.append("even", halves[0])
    log.append("odd", halves[1])
    log.append("even", halves[0])
    return log.read()


def q_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records and new ones of another source, appended."""
    log = Slots(spark, _folder(spark, "search-log"), "event_id long, event_type string, origin string", "event_id")
    rows = run_sql(spark, sf_dir, STATEMENTS["analytics_append"].sql)
    for origin in ("stored", "new"):
        log.append(origin, rows.where(F.col("origin") == origin))
    return log.read()


# keys by which a product's documents are found -------------------------------------------------------------

KEYS = "doc_id long, search_key string, source string"


def replace_keys(keys: Slots, run: str, found: DataFrame) -> bool:
    """The keys of each document in ``found`` (doc_id, search_key, source) in place of those it had; each key once."""
    return keys.upsert(run, found.where("search_key IS NOT NULL").groupBy("doc_id", "search_key").agg(F.min("source").alias("source")))


def add_keys(keys: Slots, run: str, more: DataFrame) -> bool:
    """Further keys; one that a document has already stays as it is."""
    if keys.done(run):
        return False
    new = more.where("search_key IS NOT NULL").groupBy("doc_id", "search_key").agg(F.min("source").alias("source"))
    return keys.append(run, new.join(keys.read().select("doc_id", "search_key"), ["doc_id", "search_key"], "left_anti"))


def q_search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all documents, those of every third document replaced by a new version's, then keys from labels added."""
    keys = Slots(spark, _folder(spark, "search-keys"), KEYS, "doc_id")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    words = docs.select("doc_id", F.explode(F.array(F.lower("source"), F.lower("lang"))).alias("search_key"), F.lit("chunk").alias("source"))
    replace_keys(keys, "first", words)
    again = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("v2-"), F.lower("lang")).alias("search_key"), F.lit("chunk").alias("source"))
    replace_keys(keys, "second", again)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("en").alias("search_key"), F.lit("label").alias("source"))
    add_keys(keys, "labels", labels)
    return keys.read()


KEYS_SQL = """
WITH d AS (SELECT doc_id, lower(source) AS s, lower(lang) AS l FROM documents),
k AS (
  SELECT doc_id, s AS search_key FROM d WHERE NOT (doc_id % 3 = 0 AND l IS NOT NULL) AND s IS NOT NULL
  UNION SELECT doc_id, l FROM d WHERE doc_id % 3 <> 0 AND l IS NOT NULL
  UNION SELECT doc_id, 'v2-' || l FROM d WHERE doc_id % 3 = 0 AND l IS NOT NULL)
SELECT doc_id, search_key, 'chunk' AS source FROM k
UNION ALL SELECT DISTINCT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'en' END, 'label' FROM labels x
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = x.doc_id AND k.search_key = CASE WHEN x.toxic = 1 THEN 'toxic' ELSE 'en' END)"""


# converted pages beside their sources ------------------------------------------------------------------------

CONVERTED = "page_id long, url string, source_sha256 string, html string, markdown string"


def convert_pages(store: Slots, run: str, pages: DataFrame) -> bool:
    """Converts pages whose source is new or has changed, and stores both in one row."""
    if store.done(run):
        return False
    ship(pages.sparkSession)
    hashed = pages.withColumn("source_sha256", F.sha2("html", 256))
    fresh = hashed.join(store.read().select("page_id", "source_sha256"), ["page_id", "source_sha256"], "left_anti")
    return store.upsert(run, fresh.select("page_id", "url", "source_sha256", "html", tree_markdown(F.col("html")).alias("markdown")))


def q_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages converted, then again with every fourth one changed."""
    store = Slots(spark, _folder(spark, "converted"), CONVERTED, "page_id")
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id", "url", "html")
    convert_pages(store, "first", pages)
    convert_pages(store, "second", pages.withColumn("html", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<h1>changed</h1>"), "html")).otherwise(F.col("html"))))
    return store.read().select("page_id", "source_sha256", F.startswith("markdown", F.lit("# changed")).alias("changed"))


CONVERTED_SQL = """
SELECT page_id, sha256(CASE WHEN page_id % 4 = 0 THEN '<h1>changed</h1>' || html ELSE html END) AS source_sha256, page_id % 4 = 0 AS changed FROM pages WHERE html IS NOT NULL"""

QUERIES = {"usage_log_append": q_usage_log, "search_log_append": q_search_log, "search_keys_replaced": q_search_keys, "converted_beside_source": q_converted}
ORACLES = {
    "usage_log_append": STATEMENTS["usage_log_default_costs"].oracle or plain(STATEMENTS["usage_log_default_costs"].sql),
    "search_log_append": plain(STATEMENTS["analytics_append"].sql),
    "search_keys_replaced": KEYS_SQL,
    "converted_beside_source": CONVERTED_SQL,
}
