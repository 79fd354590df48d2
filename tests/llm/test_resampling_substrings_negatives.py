"""Operators 11 to 13 against brute force and their SQL, and on odd rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import hard_negatives, importance, registry, substring_dedup

LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(30_000))
ODD = [
    (1, ""),
    (2, None),
    (3, "The quick brown fox jumps over the lazy dog, and then it jumps over 20 more of them before it sleeps again."),
    (3, "The quick brown fox jumps over the lazy dog, and then it jumps over 20 more of them before it sleeps again."),
    (3, "Another text of the same id: and then it jumps over 20 more of them before it sleeps again, as the other one said above here."),
    (4, "the QUICK brown fox; and then it jumps over 20 more of them before it sleeps again."),
    (5, LONG),
    (None, "The quick brown fox jumps over the lazy dog, and then it jumps over 20 more of them before it sleeps again."),
    (6, "  \t\n \n  a b  <|endoftext|> don't éß \U0001f600\U0001f600 \x00 x\x1fy \x0b\x0c z " * 3),
    (7, "a" * 5000 + " " * 77 + "\n" * 33 + "0" * 400),
    (8, "ha " * 300),
    (9, "ha " * 40 + "he"),
    (10, f"{'x' * 70} {'y' * 65} " * 20),
    (11, f"{'x' * 70} {'y' * 65} " * 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_words", "n_removed", "_cut_id", "_starts", "_cut", "id", "buckets", "rank")})


@pytest.mark.parametrize("key", ["op11_importance_resampling", "op12_substring_dedup", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, sf, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    result = con.execute(registry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    got = registry.queries()[key](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(result.fetchall(), key=str)


# 11 importance resampling ------------------------------------------------------------------------


def brute_features(text, ngram):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)
    return words, [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def brute_scores(rows, target, ngram=1, buckets=10_000, least=20, percent=10, seed="2024"):
    cut = lambda fs: Counter(zlib.crc32(f.encode()) % buckets for f in fs)
    held = [(k, *brute_features(t, ngram)) for k, t in rows]
    s = sum((cut(f) for _, _, f in held), Counter())
    t = sum((cut(brute_features(x, ngram)[1]) for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for k, words, features in held:
        weight = sum(gain[b] * n for b, n in cut(features).items())
        h = int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        score = None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(words), len(features), weight, score, None])
    fit = sorted((x for x in out if x[0] is not None and x[1] >= least), key=lambda x: (-x[4], x[0]))
    for place, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[5] = place
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("ngram", [1, 3])
def test_scores_equal_brute_force(spark, odd, sf, ngram):
    target = ["the quick brown fox", None, "", "hé 20 more of them"]
    more = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(ODD + more, "doc_id long, text string").repartition(7)
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.scores(df, wanted, ngram=ngram, buckets=500, percent=30)
    rows = sorted(map(tuple, got.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    assert rows == brute_scores(ODD + more, target, ngram, 500, percent=30)


def test_slices_of_one_row_are_counted_alike(spark, odd, monkeypatch):
    wanted = spark.createDataFrame([(1, "quick")], "item_id long, text string")
    whole = sorted(map(str, importance.scores(odd, wanted, ngram=2).collect()))
    counted = [r for b in importance._count(2, 10_000)(iter([_batch(ODD)])) for r in b.to_pylist()]
    monkeypatch.setattr(importance, "SLICE_BYTES", 1)
    small = [r for b in importance._count(2, 10_000)(iter([_batch(ODD)])) for r in b.to_pylist()]
    key = lambda r: (r["n_words"], r["n_features"], sorted(zip(r["buckets"], r["counts"], strict=True)))
    assert len(whole) == len(counted) == len(ODD) and list(map(key, counted)) == list(map(key, small))


def _batch(rows):
    return pa.RecordBatch.from_pydict({"id": pa.array([k for k, _ in rows], pa.int64()), "text_hash": pa.array(range(len(rows)), pa.int64()), "text": [t for _, t in rows]})


def test_resampled_rows_keep_their_columns(spark, odd):
    wanted = spark.createDataFrame([(1, "quick fox")], "item_id long, text string")
    got = importance.resample(odd, wanted, percent=50)
    ranks = {r.id for r in importance.scores(odd, wanted, percent=50).where("rank is not null").collect()}
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == ranks and None not in ranks


def test_resampling_of_nothing(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.scores(odd.limit(0), none).collect() == []
    got = importance.scores(odd, none, percent=100).collect()
    assert len(got) == len(ODD) and sum(r.rank is not None for r in got) == sum(r.n_words >= 20 and r.id is not None for r in got)


# 12 substring dedup ------------------------------------------------------------------------------


def brute_substrings(rows, width=13):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    least = {}
    for k, t in rows:
        words = split(t)
        for i in range(len(words) - width + 1) if k is not None else ():
            w = tuple(words[i : i + width])
            least[w] = min(k, least.get(w, k))
    out = []
    for k, t in rows:
        words, gone = split(t), set()
        for i in range(len(words) - width + 1) if k is not None else ():
            if least[tuple(words[i : i + width])] < k:
                gone.update(range(i, i + width))
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def windows_case(rng, docs, words=60, common=20):
    """Texts that share passages of many lengths in many contexts."""
    pool = [" ".join(f"p{rng.integers(40)}" for _ in range(n)) for n in rng.integers(8, 40, common)]
    word = lambda: f"w{rng.integers(3000)}"
    out = []
    for k in range(docs):
        parts = [pool[rng.integers(common)] if rng.random() < 0.3 else " ".join(word() for _ in range(rng.integers(1, words))) for _ in range(rng.integers(1, 5))]
        out.append((int(k), " ".join(parts)))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "CHUNK_ROWS", 50)
    rows = windows_case(np.random.default_rng(5), 400) + [(1000 + k, t) for k, t in windows_case(np.random.default_rng(5), 30)] + [(500 + k, t) for k, t in ODD if k]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = substring_dedup.dedup_substrings(df, hot=hot).select("doc_id", "n_words", "n_removed", "text")
    assert sorted(map(tuple, out.collect()), key=str) == brute_substrings(rows)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_substrings_of_other_widths(spark, width):
    rows = [(k, " ".join(t.split()[:30])) for k, t in windows_case(np.random.default_rng(8), 60)]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), width=width)
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", "text").collect()), key=str) == brute_substrings(rows, width)


def test_substrings_odd_rows(spark, odd):
    out = substring_dedup.dedup_substrings(odd)
    assert out.columns == [*[c for c in odd.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed"]
    assert all((r._cut_id, r._starts, r._cut, r.id, r["rank"]) == ("clash",) * 5 for r in out.collect())
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", "text").collect()), key=str) == brute_substrings(ODD)
    assert substring_dedup.dedup_substrings(odd.limit(0)).collect() == []


def test_hot_phrase_in_many_contexts(spark):
    """One phrase of 16 words in all texts: its minimiser has as many strings as there are texts."""
    phrase = " ".join(f"common{k}" for k in range(16))
    rows = [(k, f"{' '.join(f'a{k}x{i}' for i in range(9))} {phrase} {' '.join(f'b{k}x{i}' for i in range(9))}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_substrings(rows)
    for hot in (substring_dedup.HOT, 100):
        got = substring_dedup.dedup_substrings(df, hot=hot).select("doc_id", "n_words", "n_removed", "text").collect()
        assert sorted(map(tuple, got), key=str) == want and sum(r.n_removed for r in got) == 16 * 599


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)).encode() for n in (0, 5, 13, 14, 400, 1, 90)] + [b"x " * 500, b""]
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    hashes, doc = substring_dedup.word_hashes(np.frombuffer(b"".join(texts), np.uint8), begins)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.split()]
    known = defaultdict(set)
    for w, h in zip(words, hashes.tolist(), strict=True):
        known[w].add(h)
    assert all(len(h) == 1 for h in known.values())
    at, n, _ = substring_dedup.super_kmers(hashes, doc, 13, 4)
    covered = [i for a, k in zip(at.tolist(), n.tolist(), strict=True) for i in range(a, a + k)]
    assert covered == [i for i in range(len(doc) - 12) if doc[i] == doc[i + 12]] and n.max() <= substring_dedup.LONGEST


def test_very_long_text_takes_linear_time(spark):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(400_000))
    rows = [(1, text), (2, text + " end"), (3, "start " + text)]
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (400_000, 0), 2: (400_001, 400_000), 3: (400_001, 400_000)} and time.time() - began < 120


# 13 hard negatives -------------------------------------------------------------------------------


def brute_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90):
    fine = [(k, lab, [math.floor(256 * float(x)) for x in v]) for k, lab, v in rows if k is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (k, lab, v) in enumerate(fine):
        if k % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, other) for b, (i, other, w) in enumerate(fine) if b != a and len(w) == len(v)]
        best = sorted((-s, i) for s, i, other in scored if other == lab)[:positives]
        for s, i in best:
            fit = sorted((-n, j) for n, j, other in scored if other != lab and low * -s <= 100 * n <= high * -s)[:negatives]
            out += [(k, i, place, j, -s, -n) for place, (n, j) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,part", [(8192, 4096), (150, 3)])
def test_negatives_equal_brute_force(spark, sf, monkeypatch, block, part):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 200)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)).astype(np.float32)
    rows = [(int(k), int(k % 6), (centres[k % 6] + rng.normal(size=16) * 0.8).astype(np.float32).tolist()) for k in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    got = hard_negatives.mine(df, F.col("id") % 100 == 0, block=block, part=part).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 32)) * 256
    x = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 32)) * 20)
    books = hard_negatives.codebooks(x[:1000])
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(3000), pa.int64()), "node": pa.array(range(3000), pa.int64()), "label": pa.array([0] * 3000, pa.int64()), "v": pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64()))})
    coded = pa.Table.from_batches(list(hard_negatives._encode({32: books})(iter([batch]))))
    block = hard_negatives.Block(coded, books)
    low, high = block.bounds(x[:40])
    true = x[:40] @ x.T
    assert (low <= true).all() and (true <= high).all()
    tenth = np.sort(low, 1)[:, -10]
    assert (high >= tenth[:, None]).mean() < 0.25  # the others need no exact score


def test_negatives_odd_rows(spark):
    rng = np.random.default_rng(7)
    v = lambda n=8: rng.normal(size=n).round(2).tolist()
    rows = [(k, k % 3, v()) for k in range(40)] + [(200 + k, k % 3, v(3)) for k in range(30)]
    rows += [(0, 0, rows[0][2]), (0, 1, rows[0][2]), (5, 2, rows[5][2]), (None, 1, v()), (70, None, v()), (71, 1, None), (72, 1, [None] * 8), (73, 1, [float("nan")] * 8), (74, 1, [float("inf")] * 8)]
    rows += [(75, 0, [0.0] * 8), (80, 2, []), (81, 2, []), (82, 1, []), (100, 9, v()), (300, 0, [0.0] * 8)] + [(90 + k, 1, rows[1][2]) for k in range(9)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, label int, embedding array<double>, node int, block int, rank int")
    got = hard_negatives.mine(df, F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 10)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).collect() == []
    assert hard_negatives.mine(df.where("label = 9"), F.col("id") % 10 == 0).collect() == []


def test_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 2, (rng.normal(size=4) * 1e6).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 20 == 0).collect())) == brute_negatives(rows, 20)
    huge = spark.createDataFrame([(0, 0, [1e300, 1.0]), (1, 0, [1e300, -1e300]), (2, 1, [1.0, 1e200])], "vec_id long, label int, embedding array<double>")
    hard_negatives.mine(huge, F.col("id") == 0).collect()


@pytest.mark.parametrize("score,want", [(100, (30, 90)), (101, (31, 90)), (0, (0, 0)), (-10, (-3, -9)), (7, (3, 6))])
def test_score_windows_are_whole_numbers(score, want):
    assert hard_negatives.window(score, 30, 90) == want
