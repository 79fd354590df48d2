"""Substring dedup by super-k-mers of words.

A window is ``width`` consecutive words of one document.  A word goes if a window
covers it whose word sequence also starts in a document with a smaller id; windows
are judged on the input.

1. A window's minimiser is the smallest hash among its runs of ``GRAM`` words.
   Consecutive windows with one minimiser (``LONGEST`` of them at most) are a
   super-k-mer: ``width`` - 1 words more than windows, so each word travels about
   three times and not ``width`` times.
2. Minimisers alone are counted first.  One that a single row holds can't belong
   to a repeated window, so its super-k-mers stay at home.
3. The others travel as packed strings (words joined by one space).  Equal strings
   are one row with their smallest and largest id, summed up before the shuffle.
4. The strings of a minimiser meet in one bucket.  There, windows are sorted and
   equal neighbours get the smallest id of any string that holds them.
5. A minimiser with more than ``HOT`` different strings (a common phrase in many
   contexts) has no bucket: its windows are dealt out by their own words and summed
   up in the same way, so no task holds a common phrase.
6. Strings with a window that starts in a smaller document are joined to the documents
   that hold them; these get the list of their windows to drop, and then their text.

Words are the longest runs without [\\x20\\x09-\\x0D], unchanged; inside strings a word
of more than 64 bytes stands as = and its SHA-256.  Documents meet their strings by
two 64-bit hashes of them.  A null text is empty; texts of fewer words than a
window lose nothing.  Rows with equal ids never drop each other's words; a row with a null
id drops none and loses none.  Repeated rows get equal results.  Very long texts are
read whole.  Empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import keyed_join, unused
from docweave.llm.importance import slices
from docweave.scratch import discard, saved

WIDTH, GRAM, LONGEST, HOT = 13, 4, 64, 4096
SLICE_BYTES, CHUNK_ROWS = 1 << 20, 8192
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie one after another, and its text's number.

    begins: where each text begins.  Equal words have equal hashes; the reverse need not hold.
    """
    letter = (data != 32) & ((data < 9) | (data > 13))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = begins[begins < len(data)]
    first[inner] |= letter[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
    value = np.where(letter[starts[0] :], data[starts[0] :].astype(np.uint64) + np.uint64(1), np.uint64(0)) * POWERS[place & 4095]
    return mixed(np.add.reduceat(value, starts - starts[0])), np.searchsorted(begins, starts, side="right") - 1


def super_kmers(hashes: np.ndarray, doc: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of each super-k-mer, by words of all texts."""
    windows = len(hashes) - width + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        least = least * POWERS[0] + hashes[k : k + len(least)]
    least, span = mixed(least), 1
    while span < width - gram + 1:
        step = min(span, width - gram + 1 - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    at = np.flatnonzero(doc[:windows] == doc[width - 1 :])
    if not len(at):
        return at, at, at
    own = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    heads = np.flatnonzero(new)
    new |= (np.arange(len(at)) - heads[np.cumsum(new) - 1]) % LONGEST == 0
    heads = np.flatnonzero(new)
    return at[heads], np.diff(np.append(heads, len(at))), own[heads].view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Bounded parts of batches, with their texts' bytes and where each begins."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            text = part.column("text").cast(pa.large_binary())
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield part, np.frombuffer(b"".join(text.to_pylist()), np.uint8), ends


def _minimisers(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in _texts(batches):
            hashes, doc = word_hashes(data, ends[:-1])
            at, _, least = super_kmers(hashes, doc, width, gram)
            owner = doc[at]
            order = np.lexsort((least, owner))
            owner, least = owner[order], least[order]
            keep = np.ones(len(owner), bool)
            keep[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
            owner, least = owner[keep], least[keep]
            held, cut = np.unique(owner, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(owner)), pa.int32()), pa.array(least))
            rows = pa.array(held)
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("text_hash").take(rows), lists], names=["id", "text_hash", "minimisers"])

    return run


def short(word: bytes) -> bytes:
    return word if len(word) <= 64 else b"=" + hashlib.sha256(word).hexdigest().encode()


def _packed(width: int, gram: int):
    names = ["id", "text_hash", "at", "n", "minimiser", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in _texts(batches):
            hashes, doc = word_hashes(data, ends[:-1])
            at, n, least = super_kmers(hashes, doc, width, gram)
            texts, begins = part.column("text").cast(pa.large_binary()), np.searchsorted(doc, np.arange(part.num_rows))
            cuts = np.searchsorted(doc[at], np.arange(part.num_rows + 1))
            for row, shared in enumerate(part.column("shared")):
                a, b = cuts[row], cuts[row + 1]
                mine = a + np.flatnonzero(np.isin(least[a:b], shared.values.to_numpy()))
                words = [short(w) for w in texts[row].as_py().split()]
                first = at[mine] - begins[row]
                strings = [b" ".join(words[i : i + k + width - 1]) for i, k in zip(first.tolist(), n[mine].tolist(), strict=True)]
                key = [pa.array([part.column(c)[row].as_py()] * len(mine), pa.int64()) for c in ("id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*key, pa.array(first, pa.int32()), pa.array(n[mine], pa.int32()), pa.array(least[mine]), pa.array(strings, pa.binary())], names=names)

    return run


def joined(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def windows_of(packed: bytes, width: int) -> list[bytes]:
    ends, at = [], packed.find(b" ")
    while at >= 0:
        ends.append(at)
        at = packed.find(b" ", at + 1)
    ends.append(len(packed))
    return [packed[(ends[k - 1] + 1 if k else 0) : ends[k + width - 1]] for k in range(len(ends) - width + 1)]


def least_of_windows(packed: list[bytes], least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string, the smallest id of any string here that holds it; and windows a string."""
    listed = [windows_of(p, width) for p in packed]
    count = np.array([len(w) for w in listed])
    flat = pa.array([w for ws in listed for w in ws], pa.binary())
    order = pc.sort_indices(flat).to_numpy()
    ordered = flat.take(pa.array(order))
    new = np.ones(len(order), bool)
    new[1:] = ~pc.equal(ordered[1:], ordered[:-1]).to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(new)
    smallest = np.minimum.reduceat(np.repeat(least, count)[order], heads)
    out = np.empty(len(order), np.int64)
    out[order] = smallest[np.cumsum(new) - 1]
    return out, count


def _judge(rows: pa.Table, width: int) -> pa.Table:
    """(h1, h2, rows, least): strings that some document must drop a window of."""
    rows = rows.combine_chunks()
    bucket, low, high = (rows[c].to_numpy() for c in ("minimiser", "low", "high"))
    alone = np.ones(len(bucket), bool)
    same = bucket[1:] == bucket[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    rows = rows.filter(pa.array(~alone | (low < high)))
    if rows.num_rows:
        low, high = (rows[c].to_numpy() for c in ("low", "high"))
        least, count = least_of_windows(rows["packed"].to_pylist(), low, width)
        ends = np.cumsum(count)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(least))
        drops = np.minimum.reduceat(least, ends - count) < high
        rows = rows.append_column("least", lists).filter(pa.array(drops))
    else:
        rows = rows.append_column("least", pa.array([], pa.list_(pa.int64())))
    return rows.select(["h1", "h2", "rows", "least"])


def _sorted_buckets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < CHUNK_ROWS:
                continue
            rows = pa.concat_tables(held)
            bucket = rows["minimiser"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if cut:
                yield from _judge(rows.slice(0, cut), width).to_batches()
            held = [rows.slice(cut)]
        if held:
            yield from _judge(pa.concat_tables(held), width).to_batches()

    return run


def _single_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                listed = [windows_of(p, width) for p in part.column("packed").to_pylist()]
                count = [len(w) for w in listed]
                out = pa.table([part.column(c) for c in ("h1", "h2", "rows", "low", "high")], names=["h1", "h2", "rows", "low", "high"]).take(pa.array(np.repeat(np.arange(len(count)), count)))
                out = out.append_column("place", pa.array([k for n in count for k in range(n)], pa.int32())).append_column("window", pa.array([w for ws in listed for w in ws], pa.binary()))
                yield from out.to_batches()

    return run


def _hot_strings(strings: DataFrame, width: int) -> DataFrame:
    """As ``_judge``, for strings whose bucket would be too large."""
    windows = saved(strings.mapInArrow(_single_windows(width), "h1 long, h2 long, rows long, low long, high long, place int, window binary"), "hot-windows")
    smallest = saved(windows.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most"), "hot-least")
    met = keyed_join(windows, smallest, ["window"], "n", "inner").where("least < high")
    each = F.collect_list(F.struct("place", "least"))  # of one string: at most LONGEST entries
    found = met.groupBy("h1", "h2", "rows").agg(F.map_from_entries(each).alias("at"), F.max("place").alias("last"))
    none = F.lit(2**63 - 1)
    return found.select("h1", "h2", "rows", F.transform(F.sequence(F.lit(0), "last"), lambda k: F.coalesce(F.try_element_at("at", k), none)).alias("least"))


def repeated_windows(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(id, text_hash, starts): the first words, from 0, of the windows of a row that drop their words."""
    gram = min(GRAM, width)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    held = saved(rows.mapInArrow(_minimisers(width, gram), "id long, text_hash long, minimisers array<long>"), "minimisers")
    each = held.select("id", "text_hash", F.explode("minimisers").alias("minimiser"))
    shared = saved(each.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-minimisers")
    theirs = keyed_join(each, shared, ["minimiser"], "n", "inner").groupBy("id", "text_hash").agg(F.collect_set("minimiser").alias("shared"))
    met = rows.join(theirs.hint("shuffle_hash"), ["id", "text_hash"])
    packed = met.select("id", "text_hash", "text", "shared").mapInArrow(lambda b: joined(_packed(width, gram)(b)), "id long, text_hash long, at int, n int, minimiser long, packed binary")
    packed = saved(packed.withColumns({"h1": F.xxhash64("packed"), "h2": F.xxhash64(F.lit(1), "packed")}), "super-kmers")
    discard(held, shared)
    strings = packed.groupBy("minimiser", "packed").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows"))
    strings = saved(strings.withColumns({"h1": F.xxhash64("packed"), "h2": F.xxhash64(F.lit(1), "packed")}), "strings")
    buckets = strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("strings"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    buckets = saved(buckets.select("minimiser", "strings"), "buckets")
    cold = strings.join(buckets.where(F.col("strings") <= hot).select("minimiser"), "minimiser")
    cold = cold.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_sorted_buckets(width), "h1 long, h2 long, rows long, least array<long>")
    found = cold
    many = saved(buckets.where(F.col("strings") > hot), "hot-buckets")
    if not many.isEmpty():
        found = cold.unionByName(_hot_strings(keyed_join(strings, many, ["minimiser"], "strings", "inner"), width))
    found = saved(found, "repeated-strings")
    discard(strings, buckets, many)
    mine = keyed_join(packed.select("id", "text_hash", "at", "h1", "h2"), found, ["h1", "h2"], "rows", "inner")
    starts = F.filter(F.transform("least", lambda x, k: F.when(x < F.col("id"), F.col("at") + k)), lambda k: k.isNotNull())
    out = saved(mine.groupBy("id", "text_hash").agg(F.flatten(F.collect_list(starts)).alias("starts")).where(F.size("starts") > 0), "window-starts")
    discard(packed, found)
    return out


def cut(text: bytes, starts: np.ndarray | None, width: int) -> tuple[int, int, bytes]:
    """(words, words removed, the others joined by one space)."""
    words = text.split()
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    keep = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    return len(words), len(words) - len(keep), b" ".join([words[k] for k in keep.tolist()])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """df with the words left, joined by one space, as its text, and with n_words and n_removed."""
    key, mark, at, done = (unused(df, n) for n in ("_cut_id", "_cut_hash", "_starts", "_cut"))

    @F.pandas_udf("n_words long, n_removed long, text string")
    def cut_all(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = [cut((t or "").encode(), None if s is None else np.asarray(s), width) for t, s in zip(text, starts, strict=True)]
        return pd.DataFrame({"n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "text": [o[2].decode() for o in out]})

    found = repeated_windows(df, id_col, text_col, width, hot).toDF(key, mark, at)
    same = (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(mark))
    rows = df.drop("n_words", "n_removed")
    out = rows.join(found.hint("shuffle_hash"), same, "left").withColumn(done, cut_all(F.col(text_col), F.col(at)))
    return out.select(*[F.col(done)["text"].alias(c) if c == text_col else F.col(c) for c in rows.columns], F.col(done)["n_words"].alias("n_words"), F.col(done)["n_removed"].alias("n_removed"))
