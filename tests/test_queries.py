"""The library's own queries: against their SQL, and on inline fixtures."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave import registry
from docweave.functions import text
from docweave.sources import corpus, specs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value if value is None or isinstance(value, bool | int) else str(value)


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, oracle, key):
    df = registry.queries()[key](spark, sf)
    result = oracle.execute(registry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=str)
    assert got == sorted(([plain(r[names.index(c)]) for c in order] for r in result.fetchall()), key=str)


def test_flagship(spark, sf):
    assert 0 < registry.queries()[registry.FLAGSHIP](spark, sf).count() <= 20


def test_html(spark):
    html = "<nav>x</nav><h1>A</h1><p>b <b>c</b><br>d &amp;lt; <a href='/u'>e</a></p><script>z</script><!-- q --><ul><li>1<li>2</ul>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(corpus.html_to_markdown("html").alias("m"))
    first, second, third = (r.m for r in df.collect())
    assert first.startswith("# A") and "b **c**\nd &lt; [e](/u)" in first and "z" not in first and "x" not in first
    assert second is None and third == ""
    rich = "<h5>E</h5><pre><code class='language-py'>x = 1</code></pre><p>a <code>b</code></p><table><tr><th>k</th><th>v</th></tr><tr><td> 1 </td><td>2</td></tr></table>"
    got = spark.createDataFrame([(rich,)], "html string").select(corpus.html_to_markdown(F.col("html"))).first()[0]
    assert got == "##### E\n\n```py\nx = 1\n```\n\na `b`\n\n| k | v |\n| 1 | 2 |"


def test_sections():
    text = "lead\n# A\n\nbody\n```\n# no heading\n```\n## B\n\n### C\nc\n# D\nd"
    got = corpus.sections(text)
    assert [(p, n) for p, n, _ in got] == [("Preamble", 0), ("A", 1), ("A > B > C", 3), ("D", 1)]
    assert corpus.sections("no headings") == [("Document", 1, "no headings")] and corpus.sections("") == []


def test_chunks():
    big = "# T\n\n" + "\n\n".join(f"p{i} " + "w " * 39 for i in range(20))
    got = corpus.chunks(big)
    assert [c[0] for c in got] == [f"T (part {k})" for k in range(1, len(got) + 1)] and len(got) > 1
    assert all(c[4] for c in got) and got[1][2].startswith(got[0][2].split("\n\n")[-2])
    whole = corpus.chunks("# T\n\n" + "w " * 900)  # one paragraph can't be cut: no part, no parent
    assert [(c[0], c[3], c[4]) for c in whole] == [("T", 1170, None)]
    small = corpus.chunks("# A\n## x\none two\n## y\nthree\n# B\nfour")
    assert [c[0] for c in small] == ["A > x + A > y", "B"]


def test_blocks_keep_code_and_tables():
    text = "p one\n\n```\na\n\nb\n```\n\n| x |\n| y |\n\nq"
    assert corpus.blocks(text) == ["p one", "```\na\n\nb\n```", "| x |\n| y |", "q"]


def test_front_matter_and_titles(spark):
    rows = [("---\ntitle: A\nlayer: \"api\"\n---\nbody",), ("no matter",), (None,), ("---\nopen",)]
    df = spark.createDataFrame(rows, "t string").select(*text.front_matter(F.col("t"), "title", "layer"))
    assert [tuple(r) for r in df.collect()] == [("body", "A", "api"), ("no matter", None, None), (None, None, None), ("---\nopen", None, None)]
    heads = [("Document", "T", None, None), ("Preamble", "T", None, None), ("A > B", "T", "api", "x"), ("Document", "T", "api", None)]
    got = spark.createDataFrame(heads, "h string, t string, l string, p string").select(text.titled(*map(F.col, "htlp")))
    assert [r[0] for r in got.collect()] == ["T", "T > Preamble", "[api] x > A > B", "[api]"]


def test_enriched_is_cut(spark):
    df = spark.createDataFrame([("w " * 2000, "H"), ("**a** ```\n**b**\n```", "")], "c string, h string")
    one, two = (r[0] for r in df.select(text.enriched(F.col("c"), F.col("h"), F.lit("other"), F.array(F.lit("e")))).collect())
    assert one.startswith("[H]\n[entities: e]\nw w") and len(one.split()) < 768 / 1.3 + 3
    assert two == "[entities: e]\na ```\n**b**\n```"


def test_broken_descriptions(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "<x/>")], "id long, t string")
    for f in (specs.openapi_sections, specs.proto_items, specs.proto_external_types, specs.postman_requests):
        assert f(df, "id", "t").collect() == []
    assert text.nfkc(F.col("t")) is not None and spark.createDataFrame([("\ufb01",)], "t string").select(text.nfkc(F.col("t"))).first()[0] == "fi"


def test_stream_join_stays_out_of_the_driver(spark, sf):
    got = registry.queries()["queue_wait_stream"](spark, sf)
    assert got.inputFiles() and got.count() == registry.queries()["queue_wait"](spark, sf).count()
