"""The dealt operators against brute force, and on odd rows."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from docweave.llm import ann, blocks, bpe, chat_template, components, embedding_neardup, language_id, line_dedup, packing, pii, registry, simhash, url_filter

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(30_000))
ODD = [
    (1, "", "en", "x"),
    (2, None, None, None),
    (3, "The quick brown fox jumps over the lazy dog", "en", "x"),
    (3, "The quick brown fox jumps over the lazy dog", "en", "x"),
    (4, "the QUICK brown fox jumps over the lazy dog", None, "x"),
    (5, LONG, "en", "x"),
    (None, "The quick brown fox jumps over the lazy dog", "en", "x"),
    (6, "  \t\n \n  a\u00a0b  <|endoftext|> don't \u00e9\u00df \U0001f600\U0001f600  ", "fr", "x"),
    (7, "a" * 5000 + " " * 77 + "\n" * 33 + "0" * 400, "de", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, spans string").withColumn("ids", F.lit("clash")).withColumn("n_lines", F.lit(1))


def find_roots(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def group_min(ids, links):
    """Smallest id of each row's component, ignoring null ids."""
    roots = find_roots(len(ids), links)
    least = defaultdict(lambda: None)
    for i, r in zip(ids, roots, strict=True):
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return [least[r] for r in roots]


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 10)
    rows = spark.createDataFrame([(k, 0 if k % 3 else k % 50 if k % 7 else None) for k in range(1000)], "id long, key long")
    classes = rows.where("key IS NOT NULL AND key < 40").groupBy("key").agg(F.count("id").alias("n")).withColumn("x", F.col("key") * 2)
    for how in ("left", "inner"):
        for total in (None, 1000):
            got = blocks.keyed_join(rows, classes, ["key"], "n", how, total=total).select("id", "key", "x").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(classes, "key", how).select("id", "key", "x").collect()))


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 10)
    r = np.random.default_rng(4)
    links = [(999, k) for k in range(0, 300, 2)] + [(k, k + 1) for k in range(300, 340)] + [tuple(map(int, r.integers(400, 700, 2))) for _ in range(200)]
    roots = find_roots(1000, links)
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: roots[k] for k in {x for a, b in links if a != b for x in (a, b)}}


# 1 embeddings ------------------------------------------------------------------------------------


def brute_links(rows):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    longest = max(len(rows[i][1]) for i in ok)
    size = np.array([len(rows[i][1]) for i in ok])
    x = np.array([[*rows[i][1], *[0.0] * (longest - len(rows[i][1]))] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95) & (size[:, None] == size[None, :])
    np.fill_diagonal(linked, False)
    pairs = [(ok[a], ok[b]) for a, b in zip(*np.nonzero(linked), strict=True)]
    n = dict(zip(ok, linked.sum(1), strict=True))
    component = group_min([k for k, _ in rows], pairs)
    return [(k, int(n.get(i, 0)), component[i], k is not None and component[i] == k) for i, (k, _) in enumerate(rows)]


def test_embedding_links_equal_brute_force(spark, sf):
    got = registry.op1_embedding_neardup(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(brute_links(rows))


def test_embedding_hot_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 16))
    near = [(i, (base[i % 3] + rng.normal(size=16) * 0.05).astype(np.float32).tolist()) for i in range(10, 2410)]
    far = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(5000, 5200)]
    odd = [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] * 16), (5, [None] + [1.0] * 15), (None, far[0][1]), (6, far[0][1]), (6, far[0][1]), (7, [2 * x for x in far[1][1]])]
    rows = near + far + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1)).repartition(5)
    want = sorted(brute_links(rows), key=str)
    for limits in ({}, {"block": 100}, {"cores": False, "block": 100}):  # small blocks: cores and several blocks
        got = embedding_neardup.near_duplicates(df, **limits).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_embedding_cores_are_counted_without_comparing(spark, monkeypatch):
    monkeypatch.setattr(embedding_neardup, "BLOCK", 50)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2, 24))
    rows = [(i, (base[i % 2] + rng.normal(size=24) * (0.02 if i % 5 else 0.25)).tolist()) for i in range(1500)] + [(9, [1.0, 2.0]), (8, [2.0, 4.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_neardup.near_duplicates(df, block=50).collect()), key=str) == sorted(brute_links(rows), key=str)


def test_embedding_ids_with_several_vectors(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 16))
    rows = [(1, a.tolist()), (1, b.tolist()), (2, (a + 0.01).tolist()), (3, (b + 0.01).tolist())]
    got = embedding_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


@pytest.mark.parametrize("count", [10**6, 10**8])
def test_recall_of_hashes_for_more_vectors(count):
    """Pairs at the threshold itself share a bucket, for 3 hashes as for 4."""
    width, tables, probes = embedding_neardup.shape(count, 64)
    assert width == (3 if count == 10**6 else 4)
    rng = np.random.default_rng(1)
    a, other = embedding_neardup.unit(rng.normal(size=(1500, 64))), rng.normal(size=(1500, 64))
    other = embedding_neardup.unit(other - (other * a).sum(1, keepdims=True) * a)
    codes = [embedding_neardup.bucket_codes(x, tables, width, probes).reshape(len(a), tables, probes) for x in (a, 0.95 * a + np.sqrt(1 - 0.95**2) * other)]
    shared = (codes[0][:, :, :, None] == codes[1][:, :, None, :]).any((1, 2, 3))
    assert shared.mean() >= 0.999


def test_embedding_empty(spark):
    assert embedding_neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# 2 simhash ---------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows, marks):
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    return sorted(((k, f"{m:016x}", c) for (k, _), m, c in zip(rows, marks, group_min([k for k, _ in rows], links), strict=True)), key=str)


def test_simhash_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = registry.op2_simhash_neardup(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute_simhash(rows, [brute_fingerprint(t) for _, t in rows])


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    rows = [r[:2] for r in ODD]
    assert sorted(map(tuple, got), key=str) == brute_simhash(rows, [brute_fingerprint(t) for _, t in rows])
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def test_rows_without_ids_link_others(spark):
    """Texts whose fingerprints lie few bits apart, the one between them without an id."""
    marks = [(1, 0b0), (None, 0b111), (2, 0b111111), (None, 1 << 40), (3, (1 << 62) - 1), (None, (1 << 62) - 1)]
    got = {r.mark: (r.copies, r.component) for r in simhash.link_classes(spark.createDataFrame(marks, "_id long, mark long")).collect()}
    assert got == {0b0: (1, 1), 0b111: (1, 1), 0b111111: (1, 1), 1 << 40: (1, 1), (1 << 62) - 1: (2, 3)}


def test_resembling_texts(spark):
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(4000)]
    rows, want = [], []
    for g in range(60):
        base = list(r.choice(words, int(r.integers(200, 900))))
        for k in range(3):  # copies with one word in 150 changed: resemblance about 0.93 to the first, 0.87 to each other
            own = base.copy()
            for at in r.choice(len(base), len(base) // 150 * (k > 0), replace=False):
                own[at] = "changed%d" % at
            rows.append((3 * g + k, " ".join(own)))
            want.append(3 * g)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (None, "alone with no id"), (1003, rows[0][1]), (1003, rows[0][1])]
    want += [1000, 1000, 1000, 0, None, 0, 0]
    got = simhash.resembling(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    wrong = sum(a != b for a, b in zip(sorted(map(tuple, got), key=str), sorted(((i, w) for (i, _), w in zip(rows, want, strict=True)), key=str), strict=True))
    assert wrong <= 3  # of 120 near copies; nothing else is ever joined
    joined = {i: c for i, c in got if i is not None}
    assert all(c is not None and (c == i or c // 3 == i // 3) for i, c in joined.items() if i < 1000)
    assert simhash.resembling(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def jaccard(a, b, k=5):
    """Resemblance of the sets of k-word shingles, from plain strings."""
    sets = []
    for text in (a, b):
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({" ".join(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def edited(r, kind, base, share):
    new = [f"new{k}" for k in r.integers(0, 10**6, int(len(base) * share))]
    at = int(r.integers(0, len(base)))
    if kind == "appended":
        return base + new
    if kind == "inserted":
        return base[:at] + new + base[at:]
    if kind == "cut":
        return base[: -len(new)]
    own = base.copy()
    for k in r.choice(len(base), max(1, int(len(base) * share) // 9), replace=False):
        own[k] = "swapped"
    return own


@pytest.mark.parametrize("kind", ["appended", "inserted", "cut", "scattered"])
def test_resembling_finds_every_kind_of_edit(spark, kind):
    r = np.random.default_rng(31)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    while len(rows) < 240:
        base = list(r.choice(words, int(r.integers(60, 700))))
        other = edited(r, kind, base, float(r.uniform(0.15, 0.24)))
        if 0.8 <= jaccard(" ".join(base), " ".join(other)) <= 0.85:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = dict(simhash.resembling(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    found = sum(got[k] == got[k + 1] for k in range(0, len(rows), 2))
    assert found >= 100, found  # of 120


def test_resembling_equals_brute_force(spark):
    """Chains and hot groups at 0.6 to 0.95, short texts and repeats: the groups are those of the true resemblance."""
    r = np.random.default_rng(12)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(r.choice(words, n)) for n in (1, 2, 4, 5, 6, 8, 9)]
    for size, copies, share in ((300, 20, 0.3), (120, 20, 0.2), (40, 15, 0.2), (9, 8, 0.2)):
        for _ in range(3):
            base = list(r.choice(words, size))
            texts.append(" ".join(base))
            for _ in range(copies):
                kind = ("appended", "inserted", "cut", "scattered")[int(r.integers(4))]
                texts.append(" ".join(edited(r, kind, base, max(1.01 / size, float(r.uniform(0, share))))))
    texts += ["a b c d e f " * 9, "a b c d e f " * 30, "A  b\tc d e f " * 2, "", None]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = group_min(list(range(len(texts))), links)
    got = dict(simhash.resembling(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [got[k] for k in range(len(texts))] == want


def test_links_of_hot_fingerprints(spark):
    r = np.random.default_rng(2)
    marks = [int(m) for m in r.integers(0, 2**62, 40)]
    rows = [(i, marks[i % 3] ^ sum(1 << int(b) for b in r.integers(0, 60, i % 5))) for i in range(3000)] + list(enumerate(marks, 5000))
    df = spark.createDataFrame(rows, "_id long, mark long")
    values = np.array([m for _, m in rows], np.uint64)
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    want = group_min([i for i, _ in rows], zip(*np.nonzero(close), strict=True))
    for block in (1024, 20):  # small blocks: pivots and several blocks
        got = {r.mark: r.component for r in simhash.link_classes(df, block=block).collect()}
        assert all(got[m] == c for (_, m), c in zip(rows, want, strict=True))


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    r = np.random.default_rng(radius)
    for _ in range(3000):
        difference = sum(1 << int(b) for b in r.choice(64, radius, replace=False))
        assert any(m & difference == 0 for m in masks)


# 3 byte pairs ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def brute_ids(reference, text):
    ids = reference.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_equals_library(spark, sf, reference):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op3_bpe_roundtrip(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute_ids(reference, rows[r.doc_id])


def test_bpe_odd_rows(spark, odd, reference):
    got = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN).collect()
    for r in got:
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(odd.limit(0), RANKS, PATTERN).collect() == []


def test_bpe_tree_on_random_texts(reference):
    codec = bpe.codec(RANKS, PATTERN)
    r = np.random.default_rng(3)
    alphabet = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "'s", "1", "00", ".", "--", "\u00e9", "\u4e2d", "\u2003", "\x1c", "\x85", "\u00a0", "\U0001f600", "A", "x"]
    for n in (1, 2, 3, 5, 8, 20, 60, 300):
        for _ in range(150):
            text = "".join(r.choice(alphabet, n))
            assert np.frombuffer(codec.encode(text), "<i4").tolist() == reference.encode_ordinary(text), repr(text)
    for text in ("ab" * 3000, "=" * 777, "aaab" * 999 + "b" * 50, "\u4e2d\u6587" * 500):
        assert np.frombuffer(codec.encode(text), "<i4").tolist() == reference.encode_ordinary(text)


@pytest.mark.parametrize("kind", ["equal letters", "random letters", "pairs", "mixed runs", "digits", "wide"])
def test_bpe_of_very_long_matches(reference, kind):
    r = np.random.default_rng(9)
    text = {
        "equal letters": lambda: "a" * 200_000,
        "random letters": lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)),
        "pairs": lambda: "ab" * 100_000,
        "mixed runs": lambda: "".join(str(r.choice(list("aeiouxyz"))) * int(r.integers(1, 400)) for _ in range(1000))[:200_000],
        "digits": lambda: "=" * 100_000 + "-" * 99_999,
        "wide": lambda: "\u4e2d\u6587\u00e9" * 25_000,
    }[kind]()
    codec = bpe.codec(RANKS, PATTERN)
    began = time.perf_counter()
    ids = np.frombuffer(codec.encode(text), "<i4").tolist()
    assert time.perf_counter() - began < 5  # about a second where nothing else runs
    assert ids == reference.encode_ordinary(text)


def test_bpe_merges_by_rank_as_one_by_one(monkeypatch):
    codec = bpe.codec(RANKS, PATTERN)
    r = np.random.default_rng(10)
    for n in (2, 3, 7, 30, 90, 128):
        for letters in ("ab", "aeinst", "abcdefghijklmnop", "01"):
            data = "".join(r.choice(list(letters), n)).encode()
            assert codec.merged(data) == codec.leaf(data)


# 4 urls ------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM", "x://example.com/en/7", "x://example.com/en/77?q=/en/", "x://notexample.com/en/7#f", "x://example.net/de/8",
    "x://de.example.net/de/80", "x://net/de/", "x://net/de", "x://www.org/es/a/b", "x://org?/es/", "http://com/en//", "a://b://c/en/", "x://\u00c9XAMPLE.com/en/1\n2", "x://example.com:80/en/7",
    "x://example.com./en/7",
]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_equal_brute_force(spark, sf):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = registry.op4_url_filter(spark, sf).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == brute_verdict(rows[r.page_id]) for r in got)


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "clash", 7) for i, u in enumerate(URLS)], "page_id long, url string, host string, _won int")
    rules = spark.createDataFrame(registry.URL_RULES, "verdict string, host string, path string")
    for out in (url_filter.judge(df, registry.URL_RULES), url_filter.judge_by_join(df, rules)):
        for r in out.collect():
            assert (r.host, r.path, r.rule, r.verdict, r._won) == (*brute_verdict(r.url), 7), r.url
    assert url_filter.judge(df.limit(0), registry.URL_RULES).collect() == []


def test_rule_precedence():
    trie = url_filter.Trie([("block", "a.com", "/x"), ("allow", "com", "/x/y/z"), ("allow", "a.com", "/x"), ("block", "b.a.com", "")])
    assert trie.longest("a.com", "/x/y/z") == ("com/x/y/z", "allow")  # the longer of two that are nested neither way
    assert trie.longest("a.com", "/xx") == ("a.com/x", "block")
    assert trie.longest("c.b.a.com", "") == ("b.a.com", "block")


# 5 packing ---------------------------------------------------------------------------------------


def check_packing(rows, documents, whole=True):
    """Share of padding; whole: every id must be there."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(JSON)
    ids = {k: [*known.encode(t or "", add_special_tokens=False).ids, 1] for k, t in documents}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = pd.Series([k for k, _ in documents]).value_counts(dropna=False)
    for k, own in pieces.items():
        held = np.zeros(len(ids[k]), int)
        for start, length in own:
            held[start : start + length] += 1
        assert (held == (copies[k] if k is not None else 1)).all() if whole else (held <= copies[k]).all()
    padded = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert (offset == at or not whole) and length > 0
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded / max(1, sum(len(ids[k]) for k, _ in documents))


def test_packing(spark, sf):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check_packing(registry.op5_packing(spark, sf).collect(), documents) < 0.01


def test_packing_odd_rows_over_many_tasks(spark, odd):
    rows = [(i, f"text {i} " * (i % 90)) for i in range(600)] + [r[:2] for r in ODD if r[0] is not None]
    rows = [(k + 1000 if len(t or "") > 100_000 else k, t) for k, t in rows if k not in range(1, 8)] + [(1, ""), (2, None), (7, ODD[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(150)
    out = packing.pack(df, JSON, PATTERN, open_windows=2).withColumn("ids_crc32", F.crc32("ids"))
    assert check_packing(out.collect(), rows) < 0.01
    assert packing.pack(odd.limit(0), JSON, PATTERN).collect() == []
    assert packing.pack(odd.where("doc_id IS NULL"), JSON, PATTERN).count() > 0


def test_packing_added_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(JSON)
    assert known.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    rows = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, " x  <|endoftext|> y\n<|endoftext|><|endoftext|"), (4, "don't  <|end")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), JSON, PATTERN).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == {k: [*known.encode(t, add_special_tokens=False).ids, 1] for k, t in rows}


# 6 lines -----------------------------------------------------------------------------------------


def brute_lines(rows):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip("\x20\t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            held[fold(line)].add(k)
    common = {x: max(i for i in ids if i is not None) for x, ids in held.items() if len(x) >= 40 and len(ids - {None}) >= 5}
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (f := fold(x)) not in common or common[f] == k]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.op6_line_dedup(spark, sf).collect()), key=str) == brute_lines(rows)


def test_lines_of_very_long_texts_take_linear_time(spark):
    text = "\n".join(f"line number {i} of a text that has a great many of them" for i in range(200_000))
    df = spark.createDataFrame([(k, text if k < 5 else f"{text}\nlast") for k in range(6)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.chars) for r in line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("chars")).collect()}
    assert got == {k: (200_000, 200_000, 0) for k in range(5)} | {5: (200_001, 0, len(text) + 5)}
    assert time.time() - began < 90


def test_lines_odd_rows(spark, odd):
    line = "\tA line that is LONG enough to be counted here \u00c9\r"
    rows = [r[:2] for r in ODD] + [(i, f"x\n{line}\n\n{line.lower() if i % 2 else line}\ny{i}\n") for i in range(20, 27)] + [(26, f"x\n{line}"), (None, line), (20, f"{line}\nz")]
    df = spark.createDataFrame([(*r, 0, 1, 2, 3, "clash") for r in rows], "doc_id long, text string, _drop int, _lost_id int, _lost_hash int, h1 int, n_lines string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_drop", "_lost_id", "_lost_hash", "h1", "n_lines", "n_dropped"]
    assert all((r._drop, r._lost_id, r._lost_hash, r.h1) == (0, 1, 2, 3) for r in out.collect())
    assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


# 7 chats -----------------------------------------------------------------------------------------


def test_chats_come_back(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    own = r"\### Assistant: </turn> ok"
    said = defaultdict(list)
    for r in [*((r.conv_id, r.turn, r.role, r.text or "") for r in rows), (-7, 0, "user", own), (-7, 1, "assistant", own)]:
        said[r[0]].append(r[1:])
    got = registry.op7_chat_format(spark, sf).collect()
    assert len(got) == len(said)
    for r in got:
        turns = sorted(said[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()


def test_chats_odd_rows(spark):
    nasty = "\\<turn></turn>\\</role>\\\\<tu<turn>rn>"
    rows = [(1, 1, "assistant", nasty), (1, 0, None, None), (1, None, "us</role>er", ""), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    rows += [(None, 0, "user", "x" * 100_000)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    every = chat_template.read_chats(chat_template.format_chats(df)).collect()
    got = {r.conv_id: r for r in every}
    assert len(every) == 4  # each row without an id stands alone
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("assistant", nasty), ("us</role>er", "")] and got[1].loss_text == nasty
    assert [tuple(t) for t in got[2].turns] == [("assistant", "same")] * 2 and got[2].loss_text == "samesame"
    assert got[None].turns[0].text == "x" * 100_000 and len(got) == 3
    assert chat_template.format_chats(df.limit(0)).collect() == []


def test_template_language():
    run = lambda source, **env: (out := chat_template.Output(), chat_template.compiled(source)(env, out), "".join(out.parts))[2]
    assert run("a{{ 'b' ~ (1 + 2) }}") == "ab3"
    assert run("{% for x in l %}{{ loop.index0 }}{{ x.a | upper }}{% if not loop.last %},{% endif %}{% endfor %}", l=[{"a": "p"}, {"a": "q"}]) == "0P,1Q"
    assert run("{% if a == 1 %}x{% elif a == 2 or b %}y{% else %}z{% endif %}", a=2) == "y"
    assert chat_template.fold(chat_template.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ d }}{% endif %}")) == [("text", "aBc")]
    assert run("{{ '}}' }}{% if a == '%}' %}x{% endif %}{{ \"{{\" }}", a="%}") == "}}x{{"
    for wrong in ("{% if a %}x{% endif a %}", "{% if a %}x{% else b %}y{% endif %}", "{% for x in y %}z{% endfor x %}", "{{ a.__class__ }}", "{% for x in y %}", "{{ a | eval }}", "{{ a( }}", "{% import os %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.parse(wrong)


# 8 personal data ---------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert pii.base_spans(r.text) == brute_base(r.text)
    g = np.random.default_rng(4)
    parts = ["1", "25", "999", ".", "..", "+", "-", " ", "(", ")", "@", "a", "Z_", "%", "4111111111111111", "\u00e9", "x.y", "@a.b", "::"]
    for _ in range(4000):
        text = "".join(g.choice(parts, int(g.integers(1, 30))))
        assert pii.base_spans(text) == brute_base(text), text


def test_spans_query(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op8_pii_spans(spark, sf).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in brute_base(rows[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) and r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def precision_and_recall(lines):
    weights = pii.trained()
    found, wanted = ([{(k, *x) for k, (t, s) in enumerate(lines) for x in (s if gold else pii.all_spans(t, weights)[1])} for gold in (False, True)])
    return len(found & wanted) / len(found), len(found & wanted) / len(wanted)


def test_field_finds_formats_that_it_was_not_fitted_on():
    precision, recall = precision_and_recall(pii.examples(1200, seed=77, held_out=True))
    assert precision >= 0.98 and recall >= 0.95
    precision, recall = precision_and_recall(pii.examples(1200, seed=77))
    assert precision >= 0.98 and recall >= 0.98


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MAC 00:1b:44:11:3a:b7 x", []),
        ("MAC 00-1B-44-11-3A-B7", []),
        ("host fe80::1 up", [("ip", "fe80::1")]),
        ("jane AT example DOT org", [("email", "jane AT example DOT org")]),
        ("Nummer 030 1234567", [("phone", "030 1234567")]),
        ("tel +14155550100/212-555-0188", [("phone", "+14155550100"), ("phone", "212-555-0188")]),
        ("call 192.168.0.1 555-555-1234 now", [("ip", "192.168.0.1"), ("phone", "555-555-1234")]),
        ("pay 4111 1111 1111 1111 (555) 555-1234 now", [("card", "4111 1111 1111 1111"), ("phone", "(555) 555-1234")]),
        ("Am 2024-10-12 um 10:30:15 Uhr, Version 1.2.34, Seite 12 von 345", []),
        ("meet me at the point of no return", []),
    ],
)
def test_field_on_single_lines(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, pii.trained())[1]] == want


def test_field_decodes_as_enumeration_does():
    weights = pii.trained()

    def ways(ends, at, previous):
        """Every segmentation of the first ``at`` tokens, from its end: score, spans, whose last label must be previous."""
        if at == 0:
            if previous == "none":
                yield 0.0, []
            return
        for i, label, features in [(at - 1, "none", ()), *ends[at - 1]]:
            if label == previous:
                for before in pii.LABELS:
                    for total, rest in ways(ends, i, before):
                        yield total + pii.score(weights, features, label, before), [*rest, (label, i, at - 1)]

    for text in ("call 415-555-1234 20", "(415) 555-1234", "pay 4111.1111.1111.1111 now", "2024-10-12", "a at b dot com", "ip 2001:db8::5:1 or"):
        zone, ends = pii.candidates(text)
        total, best = max((w for label in pii.LABELS for w in ways(ends, len(ends), label)), key=lambda x: x[0])
        assert pii.decode(text, 0, len(text), [], weights) == [(label, zone.tokens[i][0], zone.tokens[j][1]) for label, i, j in best if label != "none"]


def test_gradient_is_that_of_the_likelihood():
    weights = {"phone:any": 0.3, "card:any": -0.2, "none>phone": 0.1, "phone:groups 3": 0.5}
    text = "x 415-555-1234 y 4111.1111.1111.1111"
    zone, ends = pii.candidates(text)

    def log_total(w):
        forward = [{"none": 0.0}]
        for j in range(len(ends)):
            sums = defaultdict(list)
            for i, label, features in [(j, "none", ()), *ends[j]]:
                sums[label] += [total + pii.score(w, features, label, p) for p, total in forward[i].items()]
            forward.append({k: float(np.logaddexp.reduce(v)) for k, v in sums.items()})
        return float(np.logaddexp.reduce(list(forward[-1].values())))

    got = pii.gradient(ends, [], weights)
    for f in weights:
        expected = (log_total(weights | {f: weights[f] + 1e-5}) - log_total(weights | {f: weights[f] - 1e-5})) / 2e-5
        assert abs(-got.get(f, 0.0) - expected) < 1e-4  # no entity is true, so these features are not


@pytest.mark.parametrize("n", [60, 70, 500, 5000])
def test_field_finds_long_local_parts_and_domains(n):
    weights = pii.trained()
    for text, found in ((f"write to {'b' * n} at example dot org today", f"{'b' * n} at example dot org"), (f"mail jane at {'c' * n} dot org today", f"jane at {'c' * n} dot org")):
        spans = pii.all_spans("some words ahead. " * 30 + text + ". and more words" * 30, weights)[1]
        at = 18 * 30 + text.index(found)
        assert ("email", at, at + len(found)) in spans


def test_zones_hold_every_candidate_of_the_whole_text():
    rng = np.random.default_rng(6)
    words = ["at", "dot", "(at)", "::", "call", "x" * 90, "12", "415-555", "@", ".", "-", "word", "\n", "org", "é", "mail"]
    weights = pii.trained()
    for _ in range(40):
        text = " ".join(words[k] for k in rng.integers(0, len(words), 120))
        base = pii.base_spans(text)
        whole = sorted(pii.decode(text, 0, len(text), sorted((a, b) for _, a, b in base), weights))
        assert sorted(pii.added_spans(text, base, weights)) == whole


def test_field_in_a_long_text_of_numbers():
    text = " ".join(str(k % 97) for k in range(20_000)) + " tel 212-555-0188"
    began = time.perf_counter()
    assert ("phone", len(text) - 12, len(text)) in pii.all_spans(text, pii.trained())[1]
    assert time.perf_counter() - began < 60


def test_pii_odd_rows(spark, odd):
    assert {r.doc_id: len(r.spans) for r in pii.find(odd).collect()}[1] == 0
    df = spark.createDataFrame([(1, "mail a.b@c.de, +1 (650) 555-1234!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.mask(df).orderBy("doc_id").collect()] == ["mail [EMAIL], [PHONE]!", None]
    assert pii.find(odd.limit(0)).collect() == []


# 9 nearest neighbours ----------------------------------------------------------------------------


def recall(spark, df, k, step, **limits):
    got = defaultdict(dict)
    for r in ann.search(df, F.col("id") % step == 0, k, **limits).collect():
        assert r.rank not in got[r.query_id]
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.select("vec_id", "embedding").collect() if r.embedding and None not in r.embedding and r.vec_id is not None}
    rows = {i: v for i, v in rows.items() if np.isfinite(v).all() and v.any()}
    hits = total = 0
    for length in {len(v) for v in rows.values()}:
        ids = np.array(sorted(i for i, v in rows.items() if len(v) == length))
        x = np.stack([rows[i] for i in ids])
        for q in ids[ids % step == 0]:
            s = x @ rows[q]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            found = [got[q][r] for r in sorted(got[q])]
            assert sorted(got[q]) == list(range(1, min(k, len(ids) - 1) + 1))
            assert found == sorted(found, key=lambda y: (-y[1], y[0])) and q not in [i for i, _ in found]
            assert all(abs(y - float((rows[i] * rows[q]).sum())) < 1e-12 for i, y in found)
            hits += len({i for i, _ in found} & set(ids[order].tolist()))
            total += len(order)
    assert all(q % step == 0 for q in got)
    return hits / total


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_through_lists(spark, scale):
    df = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    assert recall(spark, df, 20, 20) >= 0.93


def test_few_rows_are_all_found(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert recall(spark, df.limit(12), 20, 1) == 1
    assert recall(spark, df.limit(1), 20, 1) == 1 if df.limit(1).first().vec_id is None else True


def hot_and_odd_vectors(spark):
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(5000, 32)), g.normal(size=(1, 32)) + 0.01 * g.normal(size=(1500, 32))]) * g.uniform(0.5, 1.5, (6500, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [float("inf")] * 32), (9005, [None] * 32), (None, rows[0][1]), rows[7], (9006, rows[7][1])]
    rows += [(k, [float(1 + k % 7), float(1 + k % 3)]) for k in range(20_000, 20_060)] + [(30_000, [2.0, 1.0, 5.0])]  # other lengths, with ties
    rows += [(k, rows[40][1]) for k in range(10_000, 12_500)]  # copies of a query
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash")).withColumn("node", F.lit(0)).repartition(6)


def test_recall_over_lists_and_odd_vectors(spark):
    assert recall(spark, hot_and_odd_vectors(spark), 20, 20) >= 0.93


def test_recall_over_lists_cut_again(spark):
    assert recall(spark, hot_and_odd_vectors(spark), 20, 20, split=60) >= 0.9


def test_an_id_with_two_vectors_asks_twice(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, 5).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 0.9), (1, 2, 0.9), (2, 1, 0.1), (2, 2, 0.1), (3, 0, 0.0), (3, 0, 0.0)]


def test_search_of_nothing(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []


# 10 languages ------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = registry.op10_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_bundles_equal_their_definition():
    a, b, c = language_id.letter_vectors().astype(int)
    text = "A b\u00e9c, ab 1"
    s = [0] + [0 if not ch.isalpha() else int(language_id.symbol_table()[ord(ch)]) for ch in "a b\u00e9c ab"] + [0]
    want = sum(a[s[i]] * b[s[i + 1]] * c[s[i + 2]] for i in range(len(s) - 2))
    assert (language_id.bundles([language_id.trigrams(text)])[0] == want).all()


def test_languages_equal_their_definition(spark, sf):
    """Fit and prediction of every document of the smallest table, gram by gram."""
    a, b, c = language_id.letter_vectors().astype(int)
    table = language_id.symbol_table()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def vector(text):
        words = "".join(ch if ch.isalpha() else " " for ch in text or "").split()
        s = [0, *[x for w in words for x in (*(int(table[ord(ch)]) for ch in w), 0)]]
        grams = Counter(zip(s, s[1:], s[2:], strict=False))
        return sum(n * (a[i] * b[j] * c[k]) for (i, j, k), n in grams.items()) if grams else np.zeros(language_id.DIMENSIONS)

    vectors = {r.doc_id: vector(r.text) for r in rows}
    langs = sorted({r.lang for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1})
    fitted = [sum(vectors[r.doc_id] for r in rows if r.lang == lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for lang in langs]
    fitted = np.array([v / np.linalg.norm(v) for v in fitted])
    for r in registry.op10_language_id(spark, sf).collect():
        v = vectors[r.doc_id]
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = fitted @ v / np.linalg.norm(v)
        assert abs(max(cosines.max(), 0) - r.score) < 1e-5 and cosines[langs.index(r.lang_pred)] > cosines.max() - 1e-5


def test_training_sample_is_bounded_and_stable(spark):
    df = spark.createDataFrame([(k, f"text {k}", "en" if k % 3 else "de", 0) for k in range(6000)], "doc_id long, text string, lang string, share int")
    draws = [sorted(map(tuple, language_id.training_sample(x, "doc_id", "text", "lang", 100).collect())) for x in (df, df.repartition(7))]
    counts = Counter(lang for lang, _ in draws[0])
    assert draws[0] == draws[1] and all(60 < counts[x] < 150 for x in ("en", "de"))
    with pytest.raises(ValueError):
        language_id.fit(df.withColumn("lang", F.col("doc_id").cast("string")))


def test_languages_odd_rows(spark, odd):
    prototypes = language_id.fit(odd)
    got = language_id.predict(odd.withColumn("score", F.lit("clash")).withColumn("_said", F.lit(5)), prototypes).collect()
    assert all(r._said == 5 and isinstance(r.score, float) for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2))
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (3, 7, None))
    assert [r.lang_pred for r in language_id.predict(odd, {}).collect()] == ["und"] * len(ODD)
    assert language_id.fit(odd.limit(0)) == {} and language_id.predict(odd.limit(0), prototypes).collect() == []
