"""Importance resampling towards a target's distribution of hashed n-grams.

1. Each task hands bounded slices of its texts to a DuckDB of its own, in memory and
   with one thread.  Its SQL splits texts into words, unnests them, windows them
   into runs of 1 to ``ngram`` words and counts them by document and bucket; a
   registered function gives zlib's CRC of a run's UTF-8 bytes, modulo ``buckets``.
2. The counts, one row of arrays a document, are written as Parquet to the shared
   folder.  Every later step reads them there and no text again.
3. Spark merges them to one row a bucket (at most ``buckets`` rows, a parameter, which
   may be broadcast) and turns both sides' totals into each bucket's gain.
4. A document's weight is the sum of the gains of its features.  Its score adds
   Gumbel noise drawn from a hash of its id, so the highest scores are a sample
   without replacement, in proportion to the exponent of weight / 1000.
5. Scores are dealt out by ranges and sorted within each; a row's rank is its place there
   plus the sizes of the ranges before.  No task holds more than a range.

Words are the longest runs of digits, letters a-z (after lower-casing A-Z alone) and
code points from 128 on.  A null or empty text has no word, weight 0 and a score
of its own.  A row with a null id counts in the totals but has a null score and is
never drawn.  Repeated rows are rows of their own, with the same score; equal scores
go to the smaller id.  Very long texts are counted whole.  An empty table gives an
empty result; with an empty target every t is 0.  Further columns are ignored by
``scores`` and kept by ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import unused
from docweave.scratch import saved

#: bytes of text that one DuckDB statement gets, beyond a single longer text
SLICE_BYTES = 4 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = "id long, text_hash long, n_words long, n_features long, buckets array<int>, counts array<long>"


def crc32(grams: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.array([None if g is None else zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.uint32())


def count_sql(ngram: int, buckets: int) -> str:
    """Bucket counts of the rows of ``texts`` (row, text), as arrays."""
    longer = "".join(
        f"""
      UNION ALL SELECT row, concat_ws(' ', {", ".join(["w", *(f"lead(w, {k}) OVER doc" for k in range(1, n))])}), lead(w, {n - 1}) OVER doc IS NOT NULL
      FROM words WINDOW doc AS (PARTITION BY row ORDER BY pos)"""
        for n in range(2, ngram + 1)
    )
    return f"""
    WITH split AS (
      SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM texts
    ), words AS (
      SELECT row, unnest(ws) AS w, {"generate_subscripts(ws, 1)" if ngram > 1 else "0"} AS pos FROM split
    ), grams AS (
      SELECT row, w AS gram, true AS whole FROM words{longer}
    ), counted AS (
      SELECT row, gram, count(*) AS n FROM grams WHERE whole GROUP BY row, gram
    ), bucketed AS (
      SELECT row, crc32(gram) % {buckets} AS bucket, sum(n) AS n FROM counted GROUP BY ALL
    )
    SELECT s.row, len(s.ws)::BIGINT AS n_words, coalesce(b.n_features, 0)::BIGINT AS n_features,
      coalesce(b.buckets, []) AS buckets, coalesce(b.counts, []) AS counts
    FROM split s LEFT JOIN (
      SELECT row, sum(n) AS n_features, list(bucket::INTEGER) AS buckets, list(n::BIGINT) AS counts FROM bucketed GROUP BY row
    ) b ON s.row = b.row ORDER BY s.row
    """


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _count(ngram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            con.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
            sql = count_sql(ngram, buckets)
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    texts = pa.table({"row": pa.array(np.arange(part.num_rows)), "text": part.column("text").cast(pa.string()).fill_null("")})
                    con.register("texts", texts)
                    found = con.sql(sql).to_arrow_table()
                    con.unregister("texts")
                    own = pa.table({"id": part.column("id"), "text_hash": part.column("text_hash")})
                    for name, kind in (("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))):
                        own = own.append_column(name, found[name].cast(kind))
                    yield from own.to_batches()

    return run


def bucket_counts(df: DataFrame, ngram: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """COUNTS for each row of df, in the shared folder."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(_count(ngram, buckets), COUNTS), "bucket-counts")


def _totals(counts: DataFrame, name: str) -> DataFrame:
    return counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("_c")).groupBy(F.col("_c.buckets").alias("bucket")).agg(F.sum("_c.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that source holds: floor(1000 ln(p / q)) with add-one smoothing."""
    both = _totals(source, "s").join(_totals(target, "t"), "bucket", "left").fillna(0, ["t"])
    all_s, all_t = (side.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0] for side in (source, target))
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * F.lit(float(all_s + buckets)) / (d(F.col("s") + 1) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """counts with the weight in place of the arrays."""

    @F.pandas_udf("long")
    def weight(bucket: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(gain[np.asarray(b)] @ np.asarray(c)) if len(b) else 0 for b, c in zip(bucket, n, strict=True)], dtype="int64")

    return counts.select("id", "text_hash", "n_words", "n_features", weight("buckets", "counts").alias("weight"))


def noise(seed: str, id_col: Column) -> Column:
    """1000 times a Gumbel variate of the id's hash, rounded down with the weight it is added to."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scores(
    df: DataFrame,
    target: DataFrame,
    percent: int = 10,
    ngram: int = 1,
    buckets: int = 10_000,
    min_words: int = 20,
    seed: str = "2024",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id_col: str = "item_id",
    target_text_col: str = "text",
) -> DataFrame:
    """(id, text_hash, n_words, n_features, weight, score, rank) for every row; rank is null for rows not drawn.

    Of the rows with an id and ``min_words`` words, floor(percent / 100 of them) are drawn.
    """
    source = bucket_counts(df, ngram, buckets, id_col, text_col)
    wanted = bucket_counts(target, ngram, buckets, target_id_col, target_text_col)
    gain = np.zeros(buckets, np.int64)
    for r in gains(source, wanted, buckets).collect():  # at most ``buckets`` rows
        gain[r.bucket] = r.gain
    rows = weights(source, gain).withColumn("score", F.col("weight") + noise(seed, F.col("id")))
    fit = F.col("id").isNotNull() & (F.col("n_words") >= min_words)
    # rows that can be drawn first, then the others; the last key parts repeated rows
    order = [F.when(fit, 0).otherwise(1), F.desc("score"), "id", "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = saved(placed.drop("_row").withColumn("_fit", fit), "ranked")
    part = F.shiftright("_place", 33)  # of such an id the upper bits number the partition, the lower ones its rows
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_fit").alias("fit")).orderBy("_part").collect()  # one a partition
    before, seen = {}, 0
    for r in sizes:
        before[r[0]] = seen
        seen += r.n
    drawn = percent * sum(r.fit for r in sizes) // 100
    if not before:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop("_place", "_fit")
    ahead = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
    rank = (ahead + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return placed.withColumn("rank", F.when(F.col("_fit") & (rank <= drawn), rank)).drop("_place", "_fit")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that are drawn, with all their columns."""
    drawn = scores(df, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    key, mark = unused(df, "_drawn_id"), unused(df, "_drawn_hash")
    drawn = drawn.select(F.col("id").alias(key), F.col("text_hash").alias(mark))
    same = (F.col(id_col) == F.col(key)) & (F.xxhash64(text_col) == F.col(mark))
    return df.join(drawn, same, "left_semi")
