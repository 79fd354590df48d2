"""Texts as files, and the table of chunks in which a document's new version replaces the old one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.scratch import shared_dir
from docweave.sources.slots import Slots
from docweave.tables import table


def store_texts(df: DataFrame, path: str, name_col: str, order_col: str, text_col: str) -> None:
    """One folder of text files for each name, its rows in order, as lines or paragraphs that follow each other."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(name_col).alias("name"), F.col(order_col).alias("_order"), F.col(text_col).alias("value"))
    rows.repartition("name").sortWithinPartitions("name", "_order").select("name", "value").write.partitionBy("name").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): each file as one UTF-8 text."""
    return spark.read.schema("value string, name string").text(path, wholetext=True).select("name", F.col("value").alias("text"))


def q_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored, a hundred ids of a language to a file, and read back."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").withColumn("file", F.concat(F.coalesce("lang", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string")))
    store_texts(docs, path, "file", "doc_id", "text")
    return read_texts(spark, path).select(F.col("name").alias("file"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


TEXTS_SQL = """
SELECT file, length(t) AS chars, sha256(t) AS text_sha256 FROM (
  SELECT coalesce(lang, 'none') || '-' || doc_id // 100 AS file, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1) x"""


def q_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks; every tenth document gets a new version of its first three lines, every 50th an additional one."""
    chunks = Slots(spark, f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}", "doc_id long, chunk_index int, content string", "doc_id")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    chunks.append("first", lines)
    again = docs.where("doc_id % 10 = 0").select("doc_id", F.posexplode(F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.concat(F.lit("v2 "), x))).alias("chunk_index", "content"))
    chunks.upsert("second", again.union(docs.where("doc_id % 50 = 0").select(-F.col("doc_id") - 1, F.lit(0), F.lit("new"))))
    rows = chunks.read().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))  # one document's chunks
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.sha2(F.array_join(F.transform("c", lambda x: x["content"]), "\n"), 256).alias("content_sha256"))


REPLACE_SQL = """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN least(3, len(l)) ELSE len(l) END AS n, sha256(CASE WHEN doc_id % 10 = 0 THEN array_to_string(list_transform(l[1:3], lambda x: 'v2 ' || x), chr(10)) ELSE text END) AS content_sha256
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) d
UNION ALL SELECT -doc_id - 1, 1, sha256('new') FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 0"""

QUERIES = {"text_scan": q_texts, "chunk_writer": q_replace}
ORACLES = {"text_scan": TEXTS_SQL, "chunk_writer": REPLACE_SQL}
