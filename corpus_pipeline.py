"""From documents to packed training windows, as five stages.

Each stage is written as Parquet and read again by the next one.  A stage looks at
the columns of documents alone; further ones are dropped.  An empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import language_id, line_dedup, packing, pii, simhash
from docweave.scratch import saved
from docweave.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: one standard deviation of an unrelated text's cosine
DEVIATION = language_id.DIMENSIONS**-0.5
#: texts of fewer trigrams say too little to be told from chance
FEW_GRAMS = 100
#: bytes of rows that Spark hands to Python at once, where the session sets none; held several times over on each core
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def _ready(spark: SparkSession) -> None:
    ship(spark)
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, hold no letter or resemble no learned language.

    A text of ``FEW_GRAMS`` trigrams or more resembles one if its cosine exceeds that of
    endless random words by 1.5 deviations; a shorter one if it exceeds 2 deviations,
    which chance alone would explain.  If no language was learned, texts with a letter
    stay.  Ties between languages decide nothing here; repeated rows all stay or all go.
    Very long texts are judged whole, in portions of bounded memory.
    """
    _ready(spark)
    prototypes = language_id.fit(docs)
    if not prototypes:
        return docs.select(*COLUMNS).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    said = language_id.predict(docs.select(*COLUMNS), prototypes, grams_col="grams")
    least = F.when(F.col("grams") < FEW_GRAMS, 2 * DEVIATION).otherwise(language_id.chance_score(prototypes) + 1.5 * DEVIATION)
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat across documents.

    Every row stays, a null text as an empty one; of a repeated line the document with
    the largest id keeps its lines.  A row with a null id never counts and never keeps one;
    repeated rows are cut alike, very long texts in time that grows with their lines.
    n_chars is counted anew.
    """
    _ready(spark)
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, one with the group's smallest id; rows without an id all stay.

    Rows are told apart by id and text, so texts without copies stay when their id repeats;
    of rows with equal id and text one stays.  Texts without words, null ones too, are
    copies of each other.
    """
    _ready(spark)
    groups = saved(simhash.resembling_rows(docs).withColumnRenamed("doc_id", "_id"), "groups")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))

    def same(side: DataFrame) -> Column:
        return (rows.doc_id == side["_id"]) & (rows["_hash"] == side["text_hash"])

    lost = groups.where("_id <> component_id").select("_id", "text_hash").distinct()
    first = groups.where("_id = component_id")
    many = saved(first.groupBy("group").count().where("count > 1").select("group"), "repeated-ids")
    if many.isEmpty():
        return rows.join(lost.hint("shuffle_hash"), same(lost), "left_anti").select(*COLUMNS)
    again = saved(first.join(many, "group", "left_semi").select("_id", "text_hash", "group").distinct(), "repeated-rows")
    apart = lost.union(again.select("_id", "text_hash"))
    single = rows.join(apart.hint("shuffle_hash"), same(apart), "left_anti")
    once = rows.join(again, same(again)).dropDuplicates(["group"])
    return single.select(*COLUMNS).union(once.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; rows stay as they are otherwise, null texts too.

    Very long texts are read whole, in time that grows with their length; repeated rows are masked alike.
    n_chars is counted anew.
    """
    _ready(spark)
    return _documents(pii.mask(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens; ids as little-endian 32-bit integers.

    Rows are packed one by one, repeated ones too; a null or empty text is its end id
    alone, a very long one fills windows of its own.
    """
    _ready(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_neardup", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL has no language profiles, fingerprints or tokenizer: tests/llm/test_pipeline.py compares every stage, and run(), with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
