"""Language detection by a naive Bayes model of letter trigrams, fitted and applied as joins.

``fit`` counts the trigrams of labelled texts by class and keeps each class's ``MOST`` most frequent
ones; ``detect`` adds up the logarithms of their smoothed shares for each class.  Both
look at the first ``SAMPLE`` characters, as the feature asks for, and at nothing else of a row.

A text of fewer than ``SHORT`` characters, and one without a known trigram, is ``other``.  Russian
texts are told by their letters where no labelled text is Russian: a class is given
the alphabet that only it uses.  Ties go to the class that comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.tables import table

#: characters looked at, fewest characters and kept trigrams a class: fixed values, the last a parameter of the model
SAMPLE, SHORT, MOST = 3000, 50, 2000
OTHER = "other"
CYRILLIC = "[а-яё]"


def _sample(text: Column) -> Column:
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.left(text, F.lit(SAMPLE))), F.lit(r"[^\p{L}]+"), F.lit(" "))), F.lit(" "))


def _grams(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, gram) of each row, one row a place."""
    # characters by position: a substring would be looked for from the text's first byte each time
    rows = df.where(text.isNotNull()).select(*keep, F.split(_sample(text), "").alias("_c"))
    cut = F.transform(F.sequence(F.lit(0), F.size("_c") - 3), lambda i: F.concat(F.get("_c", i), F.get("_c", i + 1), F.get("_c", i + 2)))
    return rows.where(F.size("_c") >= 3).select(*keep, F.explode(cut).alias("gram"))


def fit(df: DataFrame, text: Column, label: Column, most: int = MOST) -> DataFrame:
    """(class, gram, n, total): a bounded table of at most ``most`` rows a class."""
    labelled = df.withColumn("class", label).where(F.col("class").isNotNull())
    counts = _grams(labelled, text, "class").groupBy("class", "gram").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("class").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= most).drop("_at")
    totals = kept.groupBy("class").agg(F.sum("n").alias("total"))
    return kept.join(totals, "class")


def detect(df: DataFrame, id_col: str, text_col: str, model: DataFrame, most: int = MOST) -> DataFrame:
    """df's ids with ``language``."""
    text = F.col(text_col)
    mark, long = _sample(text), F.coalesce(F.length(F.btrim(text)) >= SHORT, F.lit(False))
    russian = 2 * F.regexp_count(mark, F.lit(CYRILLIC)) > F.regexp_count(mark, F.lit(r"\p{L}"))
    # rows without an id of their own would meet: each row's texts are told apart by their hash
    key = F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")
    classes = model.select("class", "total").distinct()
    # a row's trigrams are added up where they are cut: what travels is one sum for each class
    more = _grams(df.select(*key, text.alias("_text")), F.col("_text"), "_id", "_hash")
    more = more.join(F.broadcast(model.select("class", "gram", F.log(F.col("n") + 1).alias("more"))), "gram").groupBy("_id", "_hash", "class").agg(F.sum("more").alias("more"))
    rows = df.select(F.col(id_col), *key, long.alias("_long"), russian.alias("_russian"), F.greatest(F.length(mark) - 2, F.lit(0)).alias("_n"))
    grams = rows.where("_n > 0").groupBy("_id", "_hash").agg(F.sum("_n").alias("_n"))
    # a class's share of a trigram it does not know is 1 / (total + most)
    known = grams.crossJoin(F.broadcast(classes)).join(more, ["_id", "_hash", "class"], "left")
    score = F.coalesce("more", F.lit(0.0)) - F.col("_n") * F.log(F.col("total") + most)
    scored = known.select("_id", "_hash", "class", F.round(score, 6).alias("score"), F.col("more").isNotNull().alias("met"))
    best = scored.groupBy("_id", "_hash").agg(F.min_by("class", F.struct(F.negative("score").alias("less"), "class")).alias("class"), F.bool_or("met").alias("met"))
    said = F.when(~F.col("_long"), OTHER).when(F.col("_russian"), "ru").when(F.col("met"), F.col("class")).otherwise(OTHER)
    return rows.join(best, ["_id", "_hash"], "left").select(id_col, said.alias("language"))


def q_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English or other, learned from two thirds of the documents and told for all."""
    docs = table(spark, sf_dir, "documents")
    label = F.when(F.col("lang") == "en", "en").when(F.col("lang").isNotNull(), OTHER)
    model = fit(docs.where("doc_id % 3 <> 1"), F.col("text"), label)
    return detect(docs, "doc_id", "text", model)


DETECTED_SQL = rf"""
WITH s AS (
  SELECT row_number() OVER () AS row, doc_id, text, CASE WHEN lang = 'en' THEN 'en' WHEN lang IS NOT NULL THEN 'other' END AS class,
    ' ' || trim(regexp_replace(lower(left(text, {SAMPLE})), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS s FROM documents
), g AS (
  SELECT row, doc_id, class, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram FROM s WHERE length(s) >= 3
), c AS (
  SELECT class, gram, count(*) AS n, row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, gram) AS place FROM g WHERE class IS NOT NULL AND doc_id % 3 <> 1 GROUP BY class, gram
), model AS (
  SELECT class, gram, n, sum(n) OVER (PARTITION BY class) AS total FROM c WHERE place <= {MOST}
), d AS (
  SELECT row, gram, count(*) AS n FROM g GROUP BY row, gram
), scored AS (
  SELECT row, k.class, k.score - r.n * ln(k.total + {MOST}) AS score FROM (SELECT row, sum(n) AS n FROM d GROUP BY row) r
  JOIN (SELECT row, class, total, sum(d.n * ln(m.n + 1)) AS score FROM d JOIN model m USING (gram) GROUP BY row, class, total) k USING (row)
), best AS (
  SELECT row, class, row_number() OVER (PARTITION BY row ORDER BY round(score, 6) DESC, class) AS place FROM scored
)
SELECT s.doc_id, CASE WHEN text IS NULL OR length(trim(text)) < {SHORT} THEN 'other' ELSE coalesce(b.class, 'other') END AS language FROM s LEFT JOIN best b ON b.row = s.row AND place = 1
"""

QUERIES = {"language_detected": q_detected}
ORACLES = {"language_detected": DETECTED_SQL}
