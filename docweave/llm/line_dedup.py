"""Line dedup with DataFrame functions only.

Lines are split at \\n (a null or empty text is one empty line); a line's key is
the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased.  Keys of at
least ``min_length`` code points that at least ``min_documents`` documents hold
lose all their lines, except in the largest id that holds them.

Only (key hash, id, position) rows are shuffled to find the keys; the hash has
128 bits.  Documents meet the list of positions to drop once, in a hash join that
needs no sort of the texts.  A hot key is counted by partial aggregates; keys of a
large share of all lines meet their rows by broadcast (``blocks.keyed_join``).

Rows with equal ids count as one document.  A row with a null id never counts
and never keeps a dropped key.  Repeated rows get equal results.  Very long texts
are read whole, in time that grows with their lines.  Empty tables give empty
results; other columns pass through.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import keyed_join, unused
from docweave.scratch import saved

SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def repeated_lines(df: DataFrame, id_col: str, text_col: str, min_length: int, min_documents: int) -> DataFrame:
    """(_id, _text_hash, _drop): positions, from 0, that a row loses."""
    # the hash first: beside a generator it would be computed, and the text copied, for each line
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), lines_of(F.col(text_col)).alias("_lines"))
    rows = rows.select("_id", "_text_hash", F.posexplode("_lines").alias("_at", "_line"))
    # the key is no longer than the line: short lines go before they are folded
    rows = rows.where(F.length("_line") >= min_length).select("_id", "_text_hash", "_at", key_of(F.col("_line")).alias("_key")).where(F.length("_key") >= min_length)
    rows = saved(rows.select("_id", "_text_hash", "_at", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("h2")), "lines")
    held = [F.count_distinct("_id").alias("_n"), F.max("_id").alias("_keeper"), F.count("h1").alias("_rows")]
    common = saved(rows.groupBy("h1", "h2").agg(*held).where(F.col("_n") >= min_documents), "common-lines")
    lost = keyed_join(rows, common, ["h1", "h2"], "_rows", "inner").where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    return lost.groupBy("_id", "_text_hash").agg(F.array_sort(F.collect_set("_at")).alias("_drop"))


def without(lines: Column, drop: Column) -> Column:
    """lines without the ascending positions in drop, by a flag for each line; lines and flags are made once, as lambda variables."""

    def kept(own: Column) -> Column:
        begins, ends = F.concat(F.array(F.lit(-1)), drop), F.concat(drop, F.array(F.size(own)))
        flags = F.flatten(F.zip_with(begins, ends, lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False)))))
        return F.transform(F.array(flags), lambda keep: F.filter(own, lambda x, i: F.get(keep, i)))[0]

    return F.transform(F.array(lines), kept)[0]


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 40, min_documents: int = 5) -> DataFrame:
    """df with the text cut and with n_lines and n_dropped."""
    key, mark, drop = (unused(df, n) for n in ("_lost_id", "_lost_hash", "_drop"))
    lost = repeated_lines(df, id_col, text_col, min_length, min_documents).toDF(key, mark, drop)
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(mark))
    out = df.drop("n_lines", "n_dropped").join(lost.hint("shuffle_hash"), same, "left")
    lines = lines_of(F.col(text_col))
    kept = without(lines, F.col(drop))
    return out.select(
        *[
            F.when(F.col(drop).isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c)
            for c in df.columns
            if c not in ("n_lines", "n_dropped")
        ],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )
