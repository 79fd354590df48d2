"""What the fourth review found: disk and time that grew faster than they need."""

import glob

import numpy as np
import pytest

from docweave.operators import fulltext, similarity, vector_index
from docweave.scratch import shared_dir


def _shuffled(spark) -> set[str]:
    """Names of the shuffle files on this machine's disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_numbers_are_packed():
    values = np.array([0, 1, 127, 128, 300, (1 << 35) - 1, 1 << 35, (1 << 64) - 1, 5], np.uint64)
    packed, begins = fulltext._packed(values)
    assert np.diff(begins).tolist() == [1, 1, 1, 2, 2, 5, 6, 10, 1]
    assert fulltext._unpacked(packed).tolist() == values.tolist()
    assert len(fulltext._unpacked(fulltext._packed(values[:0])[0])) == 0


def test_postings_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "OPENED", 3)  # rows are opened a few at a time
    ids = [7, -3, 2**62, -(2**62), 0, 41, 40, 1_000_000]
    rows = [(i, "version " * (k % 2), f"{'x ' * 300 * k}license of versions, version version") for k, i in enumerate(ids)] + [(None, "version", "license"), (99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).localCheckpoint()
    path = f"file://{tmp_path}/postings"
    before = _shuffled(spark)
    fulltext.build(path, docs, {"source": "B", "text": "C"})
    assert not _shuffled(spark) - before
    assert spark.read.parquet(path).schema["places"].dataType.simpleString() == "binary"
    got = {}
    for r in fulltext.matches(spark, path, "version license").where("configuration = 'simple' AND term = 'version'").collect():
        got.setdefault(r.id, []).append((r.position, r.weight))
    for k, i in enumerate(ids):
        start = k % 2 + 300 * k
        assert sorted(got.pop(i)) == [(1, "B")] * (k % 2) + [(start + 4, "C"), (start + 5, "C")]
    assert not got


def test_vectors_stay_where_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    v = np.random.default_rng(5).normal(size=(500, 8))
    v[100:180] = v[7]  # copies: ties go to the smaller id
    shared = shared_dir(spark).removeprefix("file://")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = vector_index.build(spark, f"file://{tmp_path}/vectors", rows, lists=8)
    assert not glob.glob(f"{shared}/placed-vectors-*")  # a second copy of all vectors
    queries = vector_index.usable(rows.where("vec_id % 7 = 0"), "vec_id", "embedding")
    out = index.probe(queries, k=5, exact=True, probes=2)
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.query, r["rank"]): r.id for r in out.collect()}
    for i in range(0, 500, 7):
        s = np.round(unit @ unit[i], 6)
        want = [j for j in np.lexsort((np.arange(500), -s)).tolist() if j != i][:5]
        assert [got[i, r + 1] for r in range(5)] == want
    monkeypatch.setattr(vector_index, "PART", 8)  # more queries than go to the rows
    assert {(r.query, r["rank"]): r.id for r in index.probe(queries, k=5, exact=True, probes=2).collect()} == got


@pytest.mark.parametrize("few", [0, 6, 1 << 30])  # all trigrams as columns, some, none
def test_names_travel_in_sides_of_blocks(spark, monkeypatch, few):
    for name, value in {"BLOCK": 8, "SIDE": 3, "SIDES": 2, "COLUMNS": 5, "ROWS": 4, "FEW": few}.items():
        monkeypatch.setattr(similarity, name, value)
    names = {f"https://host{i % 3}.example.com/{'é' * (i % 4)}{i * 37}" for i in range(90)} | {"", "a", "ab", "😀😀", "😀😀😀", "aaaa" * 9, "aaaa" * 30}
    rows = similarity.distinct_names(spark.createDataFrame([(u,) for u in [*names, None, "AB"]], "u string"), "u")
    sets = {n: {f"  {n} "[k : k + 3] for k in range(len(n) + 1)} for n in names}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.6}
    out = similarity.similar_in_blocks(rows, 0.6)
    got = {(r.l, r.r): r.similarity for r in out.collect()}
    assert got == want and out.count() == len(want) > 500
    # 97 names are 13 blocks, thus 5 sides: each name is sent 5 times, not 13
    assert "sequence(0, 4" in out._jdf.queryExecution().logical().toString() or "[0,1,2,3,4]" in out._jdf.queryExecution().optimizedPlan().toString()


def test_similarities_are_rounded_half_up(spark):
    left = similarity._Block(np.array([0]), np.zeros(101, int), np.arange(101), 128)
    right = similarity._Block(np.array([1]), np.zeros(128, int), np.arange(128), 128)
    x, y, share = similarity._found(left, right, 0.6)
    assert share.tolist() == [101 / 128]
    names = ["".join(chr(0x4E00 + k) for k in range(n)) for n in (100, 127)]  # 99 trigrams of the longer one's are shared
    rows = similarity.distinct_names(spark.createDataFrame([(u,) for u in names], "u string"), "u")
    shared = len({f"  {names[0]} "[k : k + 3] for k in range(101)} & {f"  {names[1]} "[k : k + 3] for k in range(128)})
    got = similarity.similar_in_blocks(rows, 0.6).first().similarity
    want = spark.range(1).selectExpr(f"round({shared} / cast({101 + 128 - shared} as double), 6) AS s").first().s
    assert got == want
