"""The pipeline's stages, one by one and together, against plain versions."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from docweave.llm import language_id, pii
from tests.llm.test_operators import check_packing, group_min

ROW = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line stands in many documents and is long enough to be cut."


def rows_of(spark, pairs):
    return spark.createDataFrame([(k, t, "en", "x", -1) for k, t in pairs], ROW)


def noise(r, words, letters="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(words))


def odd_rows(documents):
    r = random.Random(3)
    long = next(r.text for r in documents if r.text and r.lang == "en" and len(r.text) > 2000)
    other = next(r.text for r in documents if r.text and r.lang == "de" and len(r.text) > 1500)
    words = long.split()
    rows = [(900_001, None), (900_002, ""), (900_003, " \n "), (900_004, "12 34"), (900_005, noise(r, 400)), (900_006, noise(r, 300, "0123456789abcdef")), (900_007, "the"), (900_008, "and " * 400)]
    rows += [(900_010, long), (900_010, other), (900_009, long + " the end"), (900_011, other), (900_011, other), (None, long), (None, "the and of"), (900_012, " ".join(words * 40))]
    rows += [(900_020 + k, f"{' '.join(r.sample(words, 60))}\n  {LINE.upper() if k % 2 else LINE}\nmail {k}.x@mail.example.com or jane at mail dot org") for k in range(7)]
    return [(k, t, "en", "x", -1) for k, t in rows]


@pytest.fixture(scope="module")
def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    kept = docs.collect()
    return spark.createDataFrame([tuple(r) for r in kept] + odd_rows(kept), ROW)


def plain_languages(rows, prototypes):
    out = []
    for r in rows:
        grams = language_id.trigrams(r.text)
        if len(grams):
            v = language_id.bundles([grams])[0].astype(float)
            best = max(float(v @ p) for p in prototypes.values()) / np.linalg.norm(v)
            least = 2 / 32 if len(grams) < 100 else language_id.chance_score(prototypes) + 1.5 / 32
            if best >= least:
                out.append(tuple(r))
    return out


def plain_lines(rows):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            held[fold(line)].add(r.doc_id)
    common = {x: max(i for i in ids if i is not None) for x, ids in held.items() if len(x) >= 40 and len(ids - {None}) >= 5}
    out = []
    for r in rows:
        text = "\n".join(x for x in (r.text or "").split("\n") if fold(x) not in common or common[fold(x)] == r.doc_id)
        out.append((r.doc_id, text, r.lang, r.source, len(text)))
    return out


def shingles(text, k=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def plain_copies(rows):
    """(component of each row, rows that may stay): of each group one (id, text), of its smallest id; rows without an id."""
    texts = sorted({r.text or "" for r in rows})
    sets = [shingles(t) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (not a or len(a & b) >= 0.8 * len(a | b)):
                links.append((i, j))
    place = {t: i for i, t in enumerate(texts)}
    # rows of one text are one node; name each component by its smallest id
    n = len(texts)
    all_links = links + [(place[r.text or ""], n + k) for k, r in enumerate(rows)]
    return group_min([None] * n + [r.doc_id for r in rows], all_links)[n:]


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_language_stage(spark, sf, documents):
    got = corpus_pipeline.language_stage(spark, documents, sf).collect()
    prototypes = language_id.fit(documents)
    assert key(got) == key(plain_languages(documents.collect(), prototypes))
    kept = {r.doc_id for r in got}
    assert not kept & {900_001, 900_002, 900_003, 900_004, 900_005, 900_006} and {900_007, 900_008, 900_010, None} <= kept
    lone = rows_of(spark, [(1, "a b"), (2, "1"), (3, None)]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars", "1 AS grams")
    assert [r.doc_id for r in corpus_pipeline.language_stage(spark, lone, sf).collect()] == [1]


def test_noise_goes_and_repetition_stays(spark, sf, documents):
    prototypes = language_id.fit(documents)
    r = random.Random(8)
    texts = [(k, noise(r, n)) for k, n in enumerate([60, 100, 300, 1000, 3000] * 6)] + [(100 + k, noise(r, n, "0123456789abcdef")) for k, n in enumerate([100, 300, 1000] * 5)]
    said = language_id.predict(rows_of(spark, texts), prototypes, grams_col="n").collect()
    limit = language_id.chance_score(prototypes) + 1.5 * corpus_pipeline.DEVIATION
    assert all(x.score < limit for x in said if x.n >= 100)


def test_line_stage(spark, sf, documents):
    rows = documents.collect()
    got = corpus_pipeline.line_stage(spark, documents.withColumn("_drop", documents.doc_id), sf).collect()
    assert key(got) == key(plain_lines(rows))
    assert sum(LINE.lower() in r.text.lower() for r in got) == 1


def check_copies(rows, got):
    component = plain_copies(rows)
    named = [r for r in got if r.doc_id is not None]
    assert key(r for r in got if r.doc_id is None) == key(r for r in rows if r.doc_id is None)
    owner = {(r.doc_id, r.text): c for r, c in zip(rows, component, strict=True) if r.doc_id is not None}
    held = [owner[r.doc_id, r.text] for r in named]
    assert sorted(held) == sorted(set(owner.values()))  # one row of each group
    assert all(r.doc_id == owner[r.doc_id, r.text] for r in named)  # of its smallest id
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}


def test_simhash_stage(spark, sf, documents):
    check_copies(documents.collect(), corpus_pipeline.simhash_stage(spark, documents.withColumn("group", documents.doc_id), sf).collect())


def test_near_copies_with_repeated_ids(spark, sf):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    pairs = [(5, a), (5, b), (3, a), (7, c), (7, c), (8, d + " more"), (8, d), (9, d), (None, a), (None, "alone")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_stage(spark, rows_of(spark, pairs), sf).collect()]
    assert sorted((k, t.replace(" more", "")) for k, t in got if k is not None) == [(3, a), (5, b), (7, c), (8, d)]
    assert sorted(t for k, t in got if k is None) == sorted([a, "alone"])
    assert {k for k, _ in got} == {3, 5, 7, 8, None}


def plain_masks(rows):
    out = []
    for r in rows:
        text, kept, end = r.text, [], 0
        if text is not None:
            for kind, a, b in sorted(pii.all_spans(text, pii.trained())[1], key=lambda s: (s[1], -s[2])):
                if a >= end:
                    kept += [text[end:a], f"[{kind.upper()}]"]
                end = max(end, b)
            text = "".join([*kept, text[end:]])
        out.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    return out


def test_pii_stage(spark, sf, documents):
    got = corpus_pipeline.pii_stage(spark, documents.withColumn("spans", documents.doc_id), sf).collect()
    assert key(got) == key(plain_masks(documents.collect()))
    assert sum("[EMAIL] or [EMAIL]" in (r.text or "") for r in got) == 7


def with_crc(pieces):
    class Piece(dict):
        __getattr__ = dict.__getitem__

    return [Piece(r.asDict(), ids_crc32=zlib.crc32(bytes(r.ids))) for r in pieces]


def test_packing_stage(spark, sf, documents):
    rows = [(k, t) for k, (_, t, *_) in enumerate(documents.collect())]
    got = corpus_pipeline.packing_stage(spark, rows_of(spark, rows), sf).collect()
    assert check_packing(with_crc(got), rows) < 0.01


def test_whole_pipeline_on_odd_rows(spark, sf, documents, tmp_path):
    documents.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    class Doc(tuple):
        doc_id, text, lang, source, n_chars = (property(lambda self, k=k: self[k]) for k in range(5))

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [Doc(r) for r in plain_languages(table.collect(), language_id.fit(table))]
    rows = [Doc(r) for r in plain_lines(rows)]
    component = plain_copies(rows)
    stay = {}
    for r, c in zip(rows, component, strict=True):
        if r.doc_id is not None and r.doc_id == c:
            stay.setdefault(c, []).append(r)
    firsts = [own[0] for own in stay.values()] + [r for r in rows if r.doc_id is None]
    masked = [Doc(r) for r in plain_masks(firsts)]
    assert all(len({r.text for r in own}) == 1 for own in stay.values())  # so it does not matter which row stays
    documents_left = [(r.doc_id, r.text) for r in masked]
    assert {r.doc_id for r in got} == {k for k, _ in documents_left}
    named = [(k, t) for k, t in documents_left if k is not None]
    sequences = {r.sequence_id for r in got if r.doc_id is None}
    assert check_packing(with_crc(r for r in got if r.doc_id is not None and r.sequence_id not in sequences), named, whole=False) >= 0


def test_whole_pipeline_on_the_smallest_table(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert got and {r.doc_id for r in got} < {r.doc_id for r in table.select("doc_id").collect()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, sf, documents, stage):
    assert stage(spark, documents.limit(0), sf).collect() == []


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_neardup", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
