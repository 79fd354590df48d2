"""Pages from a stream into a table of versioned slots, each once.

Every micro-batch keeps the newest version of each page, leaves out empty pages and those whose
hash the table has already, and replaces the others in one commit that is named by the
batch.  A batch that is done again after a failure finds its name and changes nothing,
so the table is that of every batch once, in order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.scratch import shared_dir
from docweave.sources.slots import Slots
from docweave.tables import table

PAGES = "url string, version int, hash string, content string"


def newest(pages: DataFrame) -> DataFrame:
    """The last version of each page with its hash; pages without content, and null urls, are left out."""
    last = Window.partitionBy("url").orderBy(F.desc("version"), F.desc("hash"))
    rows = pages.where("url IS NOT NULL AND trim(coalesce(content, '')) <> ''").withColumn("hash", F.sha2("content", 256))
    return rows.withColumn("_at", F.row_number().over(last)).where("_at = 1").select("url", "version", "hash", "content")


def changed(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages that are new, or whose hash differs from that of the table."""
    return pages.join(known.select("url", "hash"), ["url", "hash"], "left_anti").select("url", "version", "hash", "content")


def ingest_batch(slots: Slots, pages: DataFrame, run: str) -> bool:
    if slots.done(run):
        return False
    return slots.upsert(run, changed(newest(pages), slots.read()))


def ingest(stream: DataFrame, path: str, checkpoint: str, name: str = "pages") -> None:
    """Takes what the stream has; the same checkpoint again goes on behind it."""

    def one(batch: DataFrame, number: int) -> None:
        ingest_batch(Slots(batch.sparkSession, path, PAGES, "url"), batch, f"{name}-{number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rounds(pages: DataFrame) -> list[DataFrame]:
    """Three crawls of pages: all; every third one changed and every fifth empty; the first again with new ones."""
    base = pages.select(F.col("page_id"), F.col("html"))
    url = F.concat(F.lit("/p/"), F.col("page_id").cast("string"))
    first = base.select(url.alias("url"), F.lit(1).alias("version"), F.col("html").alias("content"))
    second = base.select(url.alias("url"), F.lit(2).alias("version"), F.when(F.col("page_id") % 5 == 0, "  ").when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<!-- 2 -->"))).otherwise(F.col("html")).alias("content"))
    third = base.where("page_id % 2 = 0").select(F.concat(F.lit("/new/"), F.col("page_id").cast("string")).alias("url"), F.lit(3).alias("version"), F.col("html").alias("content"))
    return [first, second, third.unionByName(first.withColumn("version", F.lit(3)).where("url LIKE '%7'"))]


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a stream of three crawls."""
    path = f"{shared_dir(spark)}/crawled-{uuid.uuid4().hex}"
    # a crawl is one batch of as many files as it has, so no task reads all of it
    stream = lambda: spark.readStream.schema("url string, version int, content string").parquet(f"{path}-source")
    for pages in rounds(table(spark, sf_dir, "pages")):
        pages.write.mode("append").parquet(f"{path}-source")
        ingest(stream(), path, f"{path}-state")
    return Slots(spark, path, PAGES, "url").read().select("url", "version", "hash")


SQL = """
WITH first AS (SELECT page_id, '/p/' || page_id AS url, html FROM pages WHERE trim(html) <> ''),
r AS (
  SELECT url, page_id, CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 0 THEN html || '<!-- 2 -->' ELSE html END AS html, html AS old FROM first
)
SELECT url, CASE WHEN url LIKE '%7' AND html <> old THEN 3 ELSE version END AS version, sha256(CASE WHEN url LIKE '%7' THEN old ELSE html END) AS hash FROM r
UNION ALL SELECT '/new/' || page_id, 3, sha256(html) FROM pages WHERE page_id % 2 = 0 AND trim(html) <> ''
"""

QUERIES = {"stream_upsert": q_upsert}
ORACLES = {"stream_upsert": SQL}
