"""Language identification with hyperdimensional profiles.

Each letter has a random vector of ``DIMENSIONS`` signs.  A trigram's vector binds
(multiplies) the first letter's vector permuted twice, the second's permuted
once and the third's.  A text's vector bundles (adds) those of all its trigrams, a
language's prototype those of its training texts, and a text gets the
language whose prototype has the largest cosine; the score is that cosine, 0 at
least.  Ties go to the language that sorts first.

Letters are Unicode letters, lower-cased; everything else separates words as one
mark.  Letters other than a-z share ``SYMBOLS`` - 27 vectors by code point.

Prototypes are fitted on a sample of about ``per_language`` documents of each
language: those whose hash of id and text lies below per_language / documents of that
language, so the sample is the same however the table is laid out, and takes one
count and one pass.  More than ``LANGUAGES`` languages are refused.  Prediction sees
the text alone.  The prototypes' size is languages x DIMENSIONS numbers and does not
grow with the rows.

A null text or one without a letter is ``und`` with score 0; so is every text if no
language was learned.  Rows with a null id are never trained on.  Rows are
independent; empty tables give empty results; other columns pass through and
lang_pred and score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import unused

DIMENSIONS, SYMBOLS, PER_LANGUAGE, LANGUAGES = 1024, 64, 500, 4096
#: what one matrix product takes: trigrams and rows at most (a longer text by itself), different trigrams
AT_ONCE, ROWS, BLOCK = 1 << 19, 128, 4096


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
    return table


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    """(3, SYMBOLS, DIMENSIONS) signs, permuted twice, once and not at all."""
    base = np.random.default_rng(11).choice(np.int8([-1, 1]), (SYMBOLS, DIMENSIONS))
    return np.stack([np.roll(base, 2, 1), np.roll(base, 1, 1), base])


def trigrams(text: str | None) -> np.ndarray:
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = symbol_table()[points]
    symbols = symbols[(symbols > 0) | np.r_[False, symbols[:-1] > 0]] if len(symbols) else symbols
    if not symbols.any():
        return np.zeros(0, np.int32)
    s = np.concatenate([[0], symbols, [0]]).astype(np.int32)
    s = s[: -1] if s[-2] == 0 else s
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def bundles(grams: list[np.ndarray]) -> np.ndarray:
    """One vector for each list of trigrams."""
    out = np.zeros((len(grams), DIMENSIONS), np.float32)
    flat = np.concatenate(grams) if grams else np.zeros(0, np.int32)
    if not len(flat):
        return out
    place = np.zeros(SYMBOLS**3, np.int64)
    place[flat] = 1
    known = np.flatnonzero(place)
    place[known] = np.arange(len(known))
    a, b, c = letter_vectors()
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    counts = np.bincount(row * len(known) + place[flat], minlength=len(grams) * len(known)).reshape(len(grams), -1)
    for at in range(0, len(known), BLOCK):  # whole numbers: the sums are exact in any order
        k = known[at : at + BLOCK]
        bound = (a[k // SYMBOLS**2] * b[k // SYMBOLS % SYMBOLS] * c[k % SYMBOLS]).astype(np.float32)
        out += counts[:, at : at + BLOCK].astype(np.float32) @ bound
    return out


def _portions(texts: Iterator[str | None]) -> Iterator[list[np.ndarray]]:
    """Trigrams of some texts at a time, so that memory is bounded."""
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        held.append(trigrams(text))
        size += len(held[-1])
        if size > AT_ONCE or len(held) == ROWS:
            yield held
            held, size = [], 0
    if held:
        yield held


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, text) of about per_language documents of each language."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    shares = df.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes by language."""
    texts = training_sample(df, id_col, text_col, lang_col, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            at = 0
            for grams in _portions(t.as_py() for t in batch.column(1)):
                for lang, vector in zip(langs[at : at + len(grams)], bundles(grams).astype(np.float64), strict=True):
                    sums[lang] = sums.get(lang, 0) + vector
                at += len(grams)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])

    parts = texts.mapInArrow(run, "lang string, sums array<double>")
    rows = parts.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for lang, at, x in rows:
        out.setdefault(lang, np.zeros(DIMENSIONS))[at] = x
    return {lang: v / n for lang, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def chance_score(prototypes: dict[str, np.ndarray], seed: int = 13) -> float:
    """The largest cosine of endless random words, of 2 to 9 of the letters a to z, with a prototype."""
    rng = np.random.default_rng(seed)
    letters = rng.integers(ord("a"), ord("z") + 1, 400_000).astype(np.uint8)
    letters[np.cumsum(rng.integers(3, 11, len(letters) // 11))] = ord(" ")
    vector = bundles([trigrams(letters.tobytes().decode())])[0]
    return max((float(vector @ v) / float(np.linalg.norm(vector)) for v in prototypes.values()), default=0.0)


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", grams_col: str | None = None) -> DataFrame:
    """df with lang_pred and score; with grams_col, also the number of trigrams."""
    names = np.array([*prototypes, "und"], dtype=object)
    matrix = np.array([*prototypes.values()], np.float32).reshape(-1, DIMENSIONS)

    @F.pandas_udf("lang_pred string, score double, grams long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            best, score, counts = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, int)]
            for grams in _portions(iter(series)):
                counts.append(np.array([len(g) for g in grams]))
                vectors = bundles(grams)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                usable = np.array([len(g) > 0 for g in grams]) & (len(matrix) > 0)
                pick = cosines.argmax(1) if len(matrix) else np.zeros(len(grams), int)
                best.append(np.where(usable, pick, len(names) - 1))
                score.append(np.where(usable, cosines.max(1, initial=0).clip(0, 1), 0.0))
            yield pd.DataFrame({"lang_pred": names[np.concatenate(best)], "score": np.concatenate(score), "grams": np.concatenate(counts)}, index=series.index)

    said = unused(df, "_said")
    out = df.withColumn(said, run(text_col))
    fields = {"lang_pred": "lang_pred", "score": "score"} | ({grams_col: "grams"} if grams_col else {})
    return out.withColumns({name: F.col(said)[f] for name, f in fields.items()}).drop(said)


def fold_of(id_col: Column) -> Column:
    """0, 1 or 2 by the CRC-32 of the id's text; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3
