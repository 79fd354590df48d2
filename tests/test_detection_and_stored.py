"""Language detection on documents it was not fitted on; stored records by repeated runs."""

import uuid

from pyspark.sql import functions as F

from docweave.functions import detection
from docweave.operators.numbering import numbered
from docweave.sources.slots import Slots
from docweave.sources.stored import CONVERTED, KEYS, add_keys, convert_pages, replace_keys

RUSSIAN = "Настройка устройства и протокола обмена данными описана в этом документе, смотрите также раздел о правах доступа."


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND length(trim(text)) >= 50")
    label = F.when(F.col("lang") == "en", "en").otherwise("other")
    model = detection.fit(docs.where("doc_id % 3 <> 1"), F.col("text"), label)
    assert model.groupBy("class").count().agg(F.max("count")).first()[0] <= detection.MOST
    said = detection.detect(docs.where("doc_id % 3 = 1"), "doc_id", "text", model).join(docs.select("doc_id", label.alias("true")), "doc_id")
    right = said.agg(F.avg((F.col("language") == F.col("true")).cast("double"))).first()[0]
    assert right >= 0.95


def test_languages_of_odd_rows(spark):
    base = [(1, "the quick brown fox jumps over the lazy dog and the other one that was there", "en"), (2, "der schnelle braune Fuchs springt nicht nur einmal über den faulen Hund und", "de"), (3, None, "en")]
    train = spark.createDataFrame(base, "id long, t string, lang string")
    model = detection.fit(train, F.col("t"), F.when(F.col("lang") == "en", "en").otherwise("other"))
    rows = [(1, base[0][1] + " again"), (1, RUSSIAN), (2, RUSSIAN + "x" * 30), (3, None), (4, ""), (5, "short"), (6, "1234567890 " * 9), (7, base[1][1] * 40), (None, base[0][1]), (8, "漢字" * 40), (9, base[0][1]), (9, base[0][1])]
    got = detection.detect(spark.createDataFrame(rows, "id long, t string"), "id", "t", model).collect()
    assert sorted(((r.id, r.language) for r in got), key=str) == sorted(
        [(1, "en"), (1, "ru"), (2, "ru"), (3, "other"), (4, "other"), (5, "other"), (6, "other"), (7, "other"), (None, "other"), (8, "other"), (9, "en"), (9, "en")], key=str
    )
    assert detection.detect(spark.createDataFrame([], "id long, t string"), "id", "t", model).collect() == []


def test_keys_and_pages_by_repeated_runs(spark, tmp_path):
    keys = Slots(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", KEYS, "doc_id")
    found = lambda *rows: spark.createDataFrame(list(rows), KEYS)
    replace_keys(keys, "a", found((1, "x", "chunk"), (1, "x", "chunk"), (1, "y", "chunk"), (2, "z", "chunk"), (2, None, "chunk")))
    add_keys(keys, "b", found((1, "x", "llm"), (1, "w", "llm"), (3, "v", "llm")))
    replace_keys(keys, "c", found((1, "new", "chunk")))
    assert not add_keys(keys, "b", found((9, "q", "llm")))
    assert sorted(map(tuple, keys.read().collect())) == [(1, "new", "chunk"), (2, "z", "chunk"), (3, "v", "llm")]
    store = Slots(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", CONVERTED, "page_id")
    page = lambda *rows: spark.createDataFrame(list(rows), "page_id long, url string, html string")
    convert_pages(store, "1", page((1, "u", "<h1>a</h1>"), (2, "v", "<p>b</p>")))
    convert_pages(store, "2", page((1, "u", "<h1>a</h1>"), (2, "v", "<h2>c</h2>")))
    assert sorted((r.page_id, r.html, r.markdown) for r in store.read().collect()) == [(1, "<h1>a</h1>", "# a"), (2, "<h2>c</h2>", "## c")]


def test_numbers_over_many_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(6)
    got = numbered(df, [F.desc("k")]).collect()
    assert {r.k: r.number for r in got} == {k: 999 - k for k in range(1000)}
    assert numbered(df.limit(0), ["k"]).collect() == []
