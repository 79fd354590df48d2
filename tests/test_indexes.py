"""Stored indexes, stems, similarity joins and sketches against plain versions."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import stemming
from docweave.operators import fulltext, similarity, vector_index
from docweave.plans import sketches


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# stems ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "word,stem",
    [line.split() for line in """consigned consign|consigning consign|consignment consign|consistency consist|consistently consist|consolation consol|consolidating consolid|conspicuous conspicu
constable constabl|knightly knight|knitted knit|knives knive|knots knot|generously generous|communication communic|skies sky|dying die|ties tie|cries cri|gas gas|this this|hoping hope|hopping hop
relational relat|rationalize ration|electricity electr|happy happi|say say|by by|agreed agre|feed feed|luxuriated luxuri|sized size|licenses licens|licensing licens|versions version|news news""".replace("\n", "|").split("|")],
)
def test_english_stems(word, stem):
    assert stemming.english(word) == stem


@pytest.mark.parametrize(
    "word,stem",
    [line.split() for line in """в в|вавиловка вавиловк|вагнера вагнер|вагон вагон|вагона вагон|вагоне вагон|важная важн|важнее важн|важнейшие важн|важнейшими важн|важничал важнича|важно важн|важного важн
важности важност|важностию важност|важность важност|важную важн|вазах ваз|вакса вакс|падаль падал|палата палат|документы документ|документов документ|документации документац|настройки настройк|ещё ещ""".replace("\n", "|").split("|")],
)
def test_russian_stems(word, stem):
    assert stemming.russian(word) == stem


def test_terms_of_configurations():
    assert [stemming.term("the", c) for c in stemming.CONFIGURATIONS] == ["the", None, "the"]
    assert [stemming.term("licenses", c) for c in stemming.CONFIGURATIONS] == ["licenses", "licens", "licens"]
    assert [stemming.term("документы", c) for c in ("simple", "russian")] == ["документы", "документ"]
    assert stemming.term("для", "russian") is None


# full text -----------------------------------------------------------------------------------------------


def brute_cover_density(parts, question):
    """Postgres' way: from each entry on, the nearest end that completes a configuration, then the latest begin."""
    entries, at = {}, 0
    for text, weight in parts:
        for word in fulltext.WORD.findall((text or "").lower()):
            at += 1
            here = {(c, t) for c in stemming.CONFIGURATIONS if (t := stemming.term(word, c)) is not None}
            entries[at] = (here, fulltext.WEIGHTS[weight])
    asked = {c: {(c, t) for t in ts} for c, ts in fulltext.question_terms(question).items() if ts}
    everything = set().union(set(), *(e for e, _ in entries.values()))
    asked = {c: ts for c, ts in asked.items() if ts <= everything}
    if not asked:
        return None
    wanted = set().union(*asked.values())
    places = [p for p in sorted(entries) if entries[p][0] & wanted]
    full = lambda a, b: any(ts <= set().union(*(entries[p][0] for p in places[a : b + 1])) for ts in asked.values())
    score, covers, a = 0.0, 0, 0
    while a < len(places):
        b = next((b for b in range(a, len(places)) if full(a, b)), None)
        if b is None:
            break
        a = max(k for k in range(a, b + 1) if full(k, b))
        inverse = sum(1 / entries[p][1] for p in places[a : b + 1])
        score += (b - a + 1) / inverse / (1 + places[b] - places[a] - (b - a))
        covers, a = covers + 1, a + 1
    return round(score, 6), covers


def test_ranks_equal_plain_cover_density(spark, folder):
    rng = np.random.default_rng(3)
    words = "license licensed licensing versions version the of a документ документы документов настройка other words here für straße 42".split()
    docs = [(int(k), " ".join(words[i] for i in rng.integers(0, len(words), rng.integers(0, 5))), " ".join(words[i] for i in rng.integers(0, len(words), rng.integers(0, 60)))) for k in range(150)]
    docs += [(900, None, None), (901, "", ""), (None, "license", "version")]
    parts = {"head": "A", "body": "C"}
    fulltext.build(folder, spark.createDataFrame(docs[:100], "doc_id long, head string, body string"), parts)
    fulltext.add(folder, spark.createDataFrame(docs[100:], "doc_id long, head string, body string"), parts)
    for question in ("license version", "licenses", "the version of документы", "nothing here", "the", "42 42 other", ""):
        want = {k: r for k, a, b in docs if k is not None and (r := brute_cover_density([(a, "A"), (b, "C")], question))}
        got = {r.id: (r.score, r.covers) for r in fulltext.ranked(spark, folder, question).collect()}
        assert got.keys() == want.keys(), question
        assert all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want), question


def test_a_search_reads_its_terms_files_alone(spark, sf):
    path = fulltext.documents_index(spark, sf)
    shown = plan(fulltext.matches(spark, path, "license version"))
    assert "PartitionFilters: [isnotnull(bucket" in shown or "PartitionFilters: [bucket" in shown
    assert "PushedFilters" in shown and "documents" not in shown
    buckets = spark.read.parquet(path).select("term", "bucket").distinct().where("term IN ('license', 'version', 'licens')").select("bucket").distinct().count()
    assert buckets <= 3


# vectors -------------------------------------------------------------------------------------------------


def brute_neighbours(x, queries, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(u @ u[q], 6)
        out[q] = [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:k]
    return out


def test_vector_index(spark, folder):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.3
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(spark, folder, df.where("vec_id < 1500 OR vec_id >= 5000 OR vec_id IS NULL"), lists=32)
    index = index.append(df.where("vec_id >= 1500 AND vec_id < 5000"), "vec_id", "embedding")  # no rebuild
    asked = list(range(0, 2000, 40))
    queries = vector_index.usable(df.where(F.col("vec_id").isin(asked)), "vec_id", "embedding")
    want = brute_neighbours(x, asked, 10)
    near = {}
    for r in index.probe(queries, k=10).orderBy("query", "rank").collect():
        near.setdefault(r["query"], []).append(r.id)
    recall = np.mean([len(set(near[q]) & set(want[q])) / 10 for q in asked])
    assert recall >= 0.95 and index.probes < 16
    exact = {}
    for r in index.probe(queries, k=10, exact=True, probes=1).orderBy("query", "rank").collect():
        exact.setdefault(r["query"], []).append(r.id)
    assert exact == want
    assert {i for ids in near.values() for i in ids} & set(range(1500, 2000))
    one = index.probe(queries.where("id = 0"), k=5, probes=2)
    shown = plan(one)
    assert "PartitionFilters: [list" in shown and "list" in shown.split("PartitionFilters")[1][:80]


# names ---------------------------------------------------------------------------------------------------


def grams(name):
    padded = f"  {name.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8])
def test_similar_names_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(9)
    syllables = "ba be bi do du fa ka le mi no ra se ti zo an er in".split()
    name = lambda: " ".join("".join(syllables[k] for k in rng.integers(0, len(syllables), rng.integers(1, 4))) for _ in range(rng.integers(1, 4)))
    left, right = {name() for _ in range(120)} | {"", "a"}, {name() for _ in range(200)} | {"a", "ab"}
    a = similarity.distinct_names(spark.createDataFrame([(x,) for x in [*left, None]], "n string"), "n")
    b = similarity.distinct_names(spark.createDataFrame([(x,) for x in right], "n string"), "n")
    got = {(r.l, r.r): r.similarity for r in similarity.similar(a, b, threshold).collect()}
    want = {(x, y): round(s, 6) for x in left for y in right if (s := len(grams(x) & grams(y)) / len(grams(x) | grams(y))) > threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_prefixes_leave_most_pairs_out(spark, sf):
    """Of the pairs that share a trigram, the filters leave a small part to be verified."""
    names = similarity.distinct_names(spark.read.parquet(f"{sf}/../sf0.01/pages.parquet"), "url")
    counts = names.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ordered = similarity._ordered(names, counts)
    other = ordered.select(F.col("name").alias("name"), F.col("grams").alias("grams"))
    left = similarity.candidates(ordered, other, 0.6).count()
    shared = counts.select(F.sum(F.col("n") * F.col("n"))).first()[0]
    assert left * 10 < shared and similarity.least_overlap(10, 10, 0.6) == 8


def test_resolved_names(spark):
    known = spark.createDataFrame([(3, "Blue Ring"), (1, "blue ring"), (2, "Blue Ring"), (4, "cold plate"), (5, None)], "id long, name string")
    wanted = spark.createDataFrame([(1, "Blue Ring"), (2, "BLUE RING"), (3, "blue rang"), (4, "zzz"), (5, None), (6, "cold plates")], "wanted_id long, wanted string")
    got = {r.wanted_id: (r.id, r.similarity) for r in similarity.resolved(wanted, known).collect()}
    assert got[1] == (2, 2.0) and got[2] == (1, 1.5) and got[3][0] == 1 and got[6][0] == 4 and 4 not in got and 5 not in got


# sketches ------------------------------------------------------------------------------------------------


def test_sketches_merge_over_hours(spark, folder):
    rng = np.random.default_rng(1)
    base = 1_704_067_200
    rows = [(base + int(t), "ab"[int(t) % 2], float(v), int(u)) for t, v, u in zip(rng.integers(0, 5 * 86_400, 20_000), rng.gamma(2, 30, 20_000), rng.integers(0, 900, 20_000), strict=True)]
    df = spark.createDataFrame(rows, "s long, kind string, value double, who long").withColumn("ts", F.timestamp_seconds("s"))
    df = df.union(spark.createDataFrame([(base + 10, "a", None, None)], "s long, kind string, value double, who long").withColumn("ts", F.timestamp_seconds("s")))
    half = df.where("s % 2 = 0"), df.where("s % 2 = 1")
    for part in half:  # an hour's rows may come in parts
        sketches.store(folder, part, "kind", "value", "who")
    merged = sketches.between(spark, folder, "2024-01-02 00:00:00", "2024-01-04 12:00:00")
    assert "PartitionFilters: [isnotnull(day" in plan(merged)
    first, last = base + 86_400, base + 3 * 86_400 + 43_200
    got = merged.select("group", "n", *[sketches.quantile(F.col("values"), q).alias(f"q{int(q * 100)}") for q in sketches.QUANTILES], F.hll_sketch_estimate("whom").alias("users")).collect()
    assert len(got) == 2
    for r in got:
        own = sorted(v for s, k, v, _ in rows if k == r.group and first <= s < last)
        assert r.n == len(own)
        for q in sketches.QUANTILES:
            assert abs(np.searchsorted(own, r[f"q{int(q * 100)}"]) / len(own) - q) <= 0.01
        users = len({u for s, k, _, u in rows if k == r.group and first <= s < last})
        assert math.isclose(r.users, users, rel_tol=0.03)
    assert sketches.between(spark, folder, "2030-01-01 00:00:00", "2031-01-01 00:00:00").collect() == []
