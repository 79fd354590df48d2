"""SimHash near-dedup by covering locality-sensitive hashing.

A text's words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z) give shingles of
``words`` words, repeats included; a text of fewer words is one shingle and a
text without words has fingerprint zero.  Bit b of the fingerprint is set if it
is set in over half of the shingles' XXH64 values (seed 42).

Links are fingerprints that differ in at most ``radius`` bits.  Bit position i
gets a vector phi(i) of radius + 1 bits; each nonzero vector a of that length
makes one mask, of the positions with <phi(i), a> odd.  The up to ``radius``
differing positions span less than the whole space, so some a is orthogonal to
all of them and its mask hides every difference: each pair within the radius
meets in a table with certainty, and no pair needs luck.

Equal fingerprints form one class first, so copies never meet each other.
Tables hold distinct fingerprints; buckets are compared in blocks and emit at
most one row per member.  Very full buckets lend up to ``POINTS`` of their members as
pivots: fingerprints within the radius of a pivot are linked to it at once, and as
they are then joined, they are not compared with each other.

Null and empty texts have fingerprint zero.  Repeated rows get equal results.
Rows with a null id join their class but never name it; a class of null ids only
has a null component_id.  Empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import BLOCK, block_pairs, dealt, grouped, keyed_join, labels, split_sides, star_edges
from docweave.llm.components import components
from docweave.scratch import saved

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLACES = 256 * np.arange(8)
POINTS = 4


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() is A-Z only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, max(1, len(found) - words + 1))


def majority(h: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; zero without any."""
    if not len(h):
        return 0
    seen = np.zeros(2048, np.int64)
    for part in np.array_split(h, len(h) // 65_536 + 1):
        seen += np.bincount((part.astype("<u8").view(np.uint8).reshape(-1, 8) + PLACES).ravel(), minlength=2048)
    counts = np.einsum("pv,vb->pb", seen.reshape(8, 256), BITS).ravel()
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def wide_fingerprint(h: np.ndarray, parts: int = 4) -> list[int]:
    """Fingerprints of the same shingles under several hashes, each remixed from the first."""
    out = []
    for k in range(parts):
        mixed = h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for _ in range(2):
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(majority(mixed ^ mixed >> np.uint64(32)))
    return out


def word_fingerprint(text: str | None, seed: int = 42) -> int:
    """SimHash of the single words, each weighted by the root of its count."""
    counts = Counter(WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()))
    if not counts:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in counts), np.uint64, len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    sums = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + PLACES).ravel(), np.repeat(weight, 8), 2048)
    bits = np.einsum("pv,vb->pb", sums.reshape(8, 256), BITS).ravel()
    return int(np.packbits(2 * bits > weight.sum(), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["_id", "mark"])

    return run


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(_id, mark): the fingerprint as a signed long."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_fingerprints(words), "_id long, mark long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each nonzero vector; bit positions are spread evenly over phi."""
    full = 1 << (radius + 1)
    phi = [1 + i % (full - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & a).bit_count() % 2) for a in range(1, full)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _link(radius: int):
    keys = ["code", "block_i", "block_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            left, right = split_sides(table)
            marks = table["mark"].to_numpy().view(np.uint64)
            linked = np.bitwise_count(marks[left][:, None] ^ marks[right][None, :]) <= radius
            nodes = table["node"].to_numpy()
            u, v = star_edges(nodes, labels(nodes, left, right, linked))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def pivots(keyed: DataFrame, tables: int, block: int) -> list[tuple[int, int]]:
    """(mark, node) of members of very full buckets, smallest node first.

    A bucket is very full if it holds more than ``4 * block`` classes and more than
    1 / (2 P) of all, P the number of shuffle partitions: at most 2 * P * tables can be.
    """
    spread = 2 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = keyed.count() / tables
    some = [F.min_by(F.struct("mark", "node"), F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in range(POINTS)]
    full = keyed.groupBy("code").agg(F.count(F.lit(1)).alias("n"), *some).where(F.col("n") > max(total / spread, 4 * block))
    chosen = full.select(F.explode(F.array(*[f"p{k}" for k in range(POINTS)])).alias("p")).select("p.*").distinct()
    return sorted(map(tuple, chosen.collect()), key=lambda p: p[1])


def _cores(points: list[tuple[int, int]], radius: int):
    """The first pivot within the radius, -1 if there is none."""
    marks = np.array([m for m, _ in points], np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("mark").to_numpy().view(np.uint64)
            core = np.full(len(own), -1, np.int64)
            for at in range(0, len(own) if len(marks) else 0, 512):
                near = np.bitwise_count(own[at : at + 512, None] ^ marks[None, :]) <= radius
                core[at : at + 512] = np.where(near.any(1), near.argmax(1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(core)], names=[*batch.schema.names, "core"])

    return run


def link_classes(marked: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(mark, copies, component): for each class of (_id, mark), its smallest reachable id.

    Links differ in at most radius bits of mark.
    """
    # classes have numbers of their own: one whose rows have no id is linked, and links others, like any
    counted = marked.groupBy("mark").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = saved(counted.withColumn("node", F.monotonically_increasing_id()), "marks")
    named = classes.select("node", "mark")
    wanted = covering_masks(radius)
    masks = F.array(*[F.lit(_signed(m)) for m in wanted])

    def in_tables(df: DataFrame) -> DataFrame:
        keyed = df.select("*", F.posexplode(masks).alias("_table", "_mask"))
        return keyed.withColumn("code", F.xxhash64("_table", F.col("mark").bitwiseAND(F.col("_mask")))).drop("_table", "_mask")

    points = pivots(in_tables(named), len(wanted), block)
    cored = saved(named.mapInArrow(_cores(points, radius), "node long, mark long, core long"), "cores")
    met = block_pairs(in_tables(cored), ["code"], F.xxhash64("mark"), block, "core")
    links = dealt(met, ["code"]).mapInArrow(_link(radius), "u long, v long")
    if points:
        centres = marked.sparkSession.createDataFrame([(k, node) for k, (_, node) in enumerate(points)], "core long, v long")
        links = links.union(cored.join(F.broadcast(centres), "core").select(F.col("node").alias("u"), "v"))
    rooted = classes.join(components(links), "node", "left").select("mark", "copies", "least", F.coalesce("component", "node").alias("_root"))
    rooted = saved(rooted, "rooted")
    groups = saved(rooted.groupBy("_root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("_classes")), "groups")
    return keyed_join(rooted, groups, ["_root"], "_classes").select("mark", "copies", "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of df."""
    marked = saved(fingerprints(df, id_col, text_col, words), "fingerprints")
    out = keyed_join(marked, saved(link_classes(marked, radius), "linked"), ["mark"], "copies")
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


WORD_MARKS = ["mark_0", "mark_1"]
CHECKS = ["check_0", "check_1", "check_2", "check_3"]
#: min-wise samples: a pair at resemblance 0.8 shares none of 20 samples of 4 shingles with probability 3e-5
BANDS, SAMPLE = 20, 4
SEEDS, FACTORS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * SAMPLE, 1), np.uint64) | np.array([0, 1], np.uint64)[:, None, None]


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each sample of the shingles, the smallest ones under SAMPLE orders; none without shingles."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.min([((part ^ SEEDS) * FACTORS).min(1) for part in np.array_split(h, len(h) // 4096 + 1)], axis=0).reshape(BANDS, SAMPLE)
    key = np.zeros(BANDS, np.uint64)
    for k in range(SAMPLE):
        key = (key ^ least[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key


def _marks(words: int):
    names = ["_id", "_hash", "key", "size", *WORD_MARKS, *CHECKS, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bands = [], []
            for value in batch.column(2):
                text = value.as_py()
                h = np.unique(shingle_hashes(text, words))
                key = xxhash.xxh64_intdigest(h.astype("<u8").tobytes())
                rows.append([key, len(h), word_fingerprint(text), word_fingerprint(text, 43), *wide_fingerprint(h)])
                bands.append(band_keys(h).view(np.int64))
            values = np.array(rows, np.uint64).reshape(-1, len(names) - 3).view(np.int64)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v) for v in values.T.copy()), lists], names=names)

    return run, ", ".join(f"{n} long" for n in names[:-1]) + ", bands array<long>"


def _near(table: pa.Table, left: np.ndarray, right: np.ndarray, check_radius: int) -> np.ndarray:
    apart = np.zeros((len(left), len(right)), np.uint16)
    for name in CHECKS:
        marks = table[name].to_numpy().view(np.uint64)
        apart += np.bitwise_count(marks[left][:, None] ^ marks[right][None, :])
    size = table["size"].to_numpy()
    a, b = size[left][:, None], size[right][None, :]
    return (apart <= check_radius) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))


def _candidates(check_radius: int):
    """(team, node, centre): members of a bucket that the bits connect; equal teams of several buckets have equal names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            values = np.concatenate(held, axis=1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["team", "node", "centre"])

        for table in grouped(batches, ["code", "block_i", "block_j"]):
            left, right = split_sides(table)
            nodes = table["key"].to_numpy()
            component = labels(nodes, left, right, _near(table, left, right, check_radius))
            for centre in np.unique(component[component != nodes]):
                team = np.unique(nodes[component == centre])
                name = np.array([xxhash.xxh64_intdigest(team.tobytes())], np.uint64).view(np.int64)
                held.append(np.stack([np.repeat(name, len(team)), team, np.repeat(centre, len(team))]))
            if len(held) >= 2000:
                yield batch()
        if held:
            yield batch()

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "hashes"])

    return run


def _resemble_enough(shared: np.ndarray | Column, a: np.ndarray | Column, b: np.ndarray | Column) -> np.ndarray | Column:
    """shared / (a + b - shared) >= 0.8, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets (node, hashes) resemble each other; the sets stay in Spark's rows, of which one pair is compared at a time."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("left")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("right")), "v")
    return both.where(_resemble_enough(F.size(F.array_intersect("left", "right")), F.size("left"), F.size("right"))).select("u", "v")


def links_within(nodes: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join members of different components, each member compared with all those not yet joined to it."""
    label = np.unique(component, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    ends = np.concatenate([[0], np.cumsum(size)])
    found, at = np.unique(np.concatenate(sets), return_inverse=True)
    links = []
    for p in range(len(nodes)):
        others = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
        if not len(others):
            continue
        own = np.zeros(len(found), np.int64)
        own[at[ends[p] : ends[p + 1]]] = 1
        shared = np.add.reduceat(own[at], ends[:-1])[others]
        for q in others[_resemble_enough(shared, size[p], size[others])]:
            if label[q] != label[p]:
                links.append((nodes[p], nodes[q]))
                label[label == label[q]] = label[p]
    return links


def _verify_teams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, ["team"]):
        links = links_within(table["node"].to_numpy(), table["component"].to_numpy(), [x.values.to_numpy() for x in table["hashes"]])
        if links:
            u, v = np.array(links, np.int64).T.copy()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def resembling(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 3, check_radius: int = 76) -> DataFrame:
    """(id, component_id), one row for each row of df; see resembling_rows."""
    return resembling_rows(df, id_col, text_col, words, radius, check_radius).select(id_col, "component_id")


def resembling_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 3, check_radius: int = 76) -> DataFrame:
    """(id, text_hash, group, component_id): groups of texts linked by a resemblance of 0.8 or more.

    Resemblance is the exact one (Jaccard) of the sets of shingles of ``words``
    words, each shingle by its 64-bit hash.  Candidates come from two kinds of marks:
    fingerprints of the texts' single words under two hashes, each in covering tables
    of ``radius`` bits, which are close where words were swapped; and fingerprints of
    parts of a text, min-wise samples of its shingles that must be equal, which are
    shared with a chance that depends on the resemblance alone, whether words were
    swapped or a passage was added, removed or cut.  That is
    2 * (2 ** (radius + 1) - 1) + ``BANDS`` rows a class, 50 as set.

    256 bits of the shingles' fingerprints only thin the candidates out: at 0.8 they
    differ in 39 on average with deviation 6, in 48 for the smallest sets (4 of 5).
    What they connect within a block of a bucket is a team.  Each member is first
    compared with the team's centre; then, in teams that this leaves apart, members of
    different components with each other.  Sets are made again from the texts of
    candidates alone, tables carry classes' names.

    Texts with equal sets of shingles form one class first; classes are named by a
    hash of the set, so that ids may repeat.  A group has a name of its own; its
    component_id is its smallest id, and text_hash is xxhash64 of the text.
    """
    run, schema = _marks(words)
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    marked = saved(texts.mapInArrow(run, schema), "fingerprints")
    marks = ["size", *WORD_MARKS, *CHECKS, "bands"]
    first = F.min(F.struct("_id", "_hash", *marks)).alias("_first")
    named = F.min("_id").alias("least")  # the struct's smallest id may be null
    classes = saved(marked.groupBy("key").agg(first, named, F.count(F.lit(1)).alias("copies")).select("key", "least", "copies", "_first.*"), "classes")
    masked = [F.col(m).bitwiseAND(F.lit(_signed(k))) for m in WORD_MARKS for k in covering_masks(radius)]
    keyed = classes.where("size > 0").select("key", F.posexplode(F.concat(F.array(*masked), "bands")).alias("_table", "_bits"))
    keyed = keyed.select("key", F.xxhash64("_table", "_bits").alias("code"))
    met = block_pairs(keyed, ["code"], F.xxhash64("key")).join(classes.select("key", "size", *CHECKS), "key")
    teams = saved(dealt(met, ["code"]).mapInArrow(_candidates(check_radius), "team long, node long, centre long").distinct(), "teams")

    wanted = teams.select("node").distinct().join(classes.select(F.col("key").alias("node"), F.col("_id").alias("_rep"), F.col("_hash").alias("_rep_hash")), "node")
    chosen = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_rep")) & (F.col("_hash") == F.col("_rep_hash"))).select("node", "_text")
    sets = saved(chosen.mapInArrow(_shingle_sets(words), "node long, hashes array<long>").dropDuplicates(["node"]), "shingles")

    pairs = teams.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    links = saved(_verified(pairs, sets), "verified")
    joined = components(links).withColumnRenamed("node", "_node")
    rest = teams.where("node <> centre").join(joined, F.col("node") == F.col("_node"), "left").select("team", "node", F.coalesce("component", "node").alias("component"))
    apart = rest.groupBy("team").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("team")
    open_teams = rest.join(apart, "team", "left_semi").join(sets, "node").repartition("team").sortWithinPartitions("team")
    links = links.union(open_teams.mapInArrow(_verify_teams, "u long, v long"))

    roots = components(links)
    of_class = classes.select("key", "least", "copies").join(roots, F.col("key") == roots.node, "left")
    of_class = saved(of_class.select("key", "least", "copies", F.coalesce("component", "key").alias("group")), "grouped")
    groups = saved(of_class.groupBy("group").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")), "groups")
    of_class = saved(keyed_join(of_class, groups, ["group"], "classes").select("key", "copies", "group", "component_id"), "grouped")
    rows = keyed_join(marked.select("_id", "_hash", "key"), of_class, ["key"], "copies")
    return rows.select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), "group", "component_id")
