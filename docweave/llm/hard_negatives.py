"""Hard-negative mining with product quantisation and stored residual norms.

Components become whole numbers, floor(scale * x); a score is the inner product of two
such vectors.  An anchor's positives are the best rows of its label; for each of
them, the best rows of other labels with a score between ``low`` and ``high`` percent of
the positive's are its hard negatives.

1. For each vector length, ``CODES`` centroids for each run of ``RUN`` components are
   fitted on a bounded sample (``SAMPLE`` rows, by hash).  Centroids are whole numbers.
2. Every row is stored with its codes and, for each run, the norm of what its
   centroid leaves: its residual.
3. Rows are cut into blocks of ``BLOCK`` and anchors into parts of ``PART``, by hash, and each
   block meets each part once.  There an anchor's table of products with all
   centroids gives each row's approximate score; by Cauchy and Schwarz the true one is
   off by at most the sum over runs of anchor's norm times residual's norm.
4. A row is left out only if that interval proves that it can't be among the best of
   its block: its upper end is below the k-th largest lower end, or the interval
   lies outside the score window.  All other rows are scored exactly in whole numbers.
5. Each block gives its k best for an anchor and window; ranked windows over those
   (pruned before their shuffle) leave the best of all.  This runs twice: for the
   positives, then for the windows that their scores set.

Rows without label, id or vector, or with a null or non-finite component, take no part.
Vectors meet those of their own length alone.  Repeated rows are rows of their own: each
is another row to its copies, and asks if it is an anchor.  Ties go to the smaller id.
Zero vectors take part.  Anchors without a positive give no rows.  Numbers beyond 2^53
are held there, scores beyond 64 bits at their ends.  Empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.scratch import saved

SAMPLE, CODES, RUN, BLOCK, PART, CHUNK = 16_384, 256, 4, 8192, 4096, 64
EXACT = 2**53
ENDS = 2**63 - 1


def runs_of(length: int) -> list[slice]:
    return [slice(k, min(k + RUN, length)) for k in range(0, length, RUN)]


def codebooks(x: np.ndarray, seed: int = 11, rounds: int = 8) -> list[np.ndarray]:
    """Whole-number centroids of each run of components, by Lloyd's rounds."""
    out = []
    for own in runs_of(x.shape[1]):
        part = np.unique(x[:, own], axis=0)
        rng = np.random.default_rng([seed, own.start])
        centres = part[rng.choice(len(part), min(CODES, len(part)), replace=False)]
        for _ in range(rounds):
            code = nearest(part, centres)
            n = np.bincount(code, minlength=len(centres))
            sums = np.stack([np.bincount(code, part[:, k], len(centres)) for k in range(part.shape[1])], 1)
            centres = np.where(n[:, None] > 0, np.rint(sums / np.maximum(n, 1)[:, None]), centres)
        out.append(centres)
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *[(size - 2 * x[at : at + 4096] @ centres.T).argmin(1) for at in range(0, len(x), 4096)]])


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _encode(books: dict[int, list[np.ndarray]]):
    """Adds codes and residual norms to batches of rows."""

    def run(batches):
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for length in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                x, runs = matrix(part.column("v")), runs_of(length)
                x = x.reshape(part.num_rows, length)
                codes, left = np.zeros((len(x), len(runs)), np.uint8), np.zeros((len(x), len(runs)))
                for m, own in enumerate(runs):
                    codes[:, m] = nearest(x[:, own], books[length][m])
                    left[:, m] = np.sqrt(((x[:, own] - books[length][m][codes[:, m]]) ** 2).sum(1)) * (1 + 1e-12)
                cuts = pa.array(np.arange(0, left.size + 1, max(len(runs), 1), dtype=np.int32)[: len(x) + 1] if runs else np.zeros(len(x) + 1, np.int32))
                columns = [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(cuts, pa.array(left.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "codes", "residuals"])

    return run


class Block:
    """The rows of a block: bounds of their scores, and the scores."""

    def __init__(self, rows: pa.Table, books: list[np.ndarray]):
        self.ids, self.nodes, self.labels = (rows[c].to_numpy() for c in ("id", "node", "label"))
        self.whole = matrix(rows["v"], np.int64).reshape(len(self.ids), -1)
        self.x = self.whole.astype(np.float64)
        self.books, self.runs = books, runs_of(self.x.shape[1])
        self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.left = matrix(rows["residuals"]).reshape(len(self.ids), -1)
        self.largest = float(np.sqrt((self.x**2).sum(1).max(initial=0)))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of each anchor's scores."""
        about, off = np.zeros((len(anchors), len(self.x))), np.zeros((len(anchors), len(self.x)))
        for m, own in enumerate(self.runs):
            about += (anchors[:, own] @ self.books[m].T)[:, self.codes[:, m]]
            off += np.sqrt((anchors[:, own] ** 2).sum(1))[:, None] * self.left[:, m]
        off += 1e-9 * (1 + np.sqrt((anchors**2).sum(1))[:, None] * (self.largest + self.left.sum(1)))  # what doubles round off
        return about - off, about + off

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> list[int] | np.ndarray:
        """Exact products of one anchor (whole numbers) with rows."""
        if float(np.abs(anchor).max(initial=0)) * float(np.abs(self.x[at]).max(initial=0)) * max(1, len(anchor)) < EXACT:
            return (self.x[at] @ anchor.astype(np.float64)).astype(np.int64)
        products = self.whole[at].astype(object) @ anchor.astype(object) if len(anchor) else np.zeros(len(at), object)
        return np.array([max(-ENDS - 1, min(ENDS, int(s))) for s in products], np.int64)


def first(scores: np.ndarray, ids: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= kth)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((nodes[kept], ids[kept], -scores[kept].astype(object) if (scores[kept] == -ENDS - 1).any() else -scores[kept]))[:k]]


def kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _positives(books: dict, k: int):
    """The k best rows of each anchor's label in a block."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {n: [] for n in ("anchor", "anchor_id", "id", "node", "score")}
        if rows.num_rows and anchors.num_rows:
            block = Block(rows, books[key[0].as_py()])
            whole = matrix(anchors["v"], np.int64).reshape(anchors.num_rows, -1)
            nodes, ids, labels = (anchors[c].to_numpy() for c in ("node", "id", "label"))
            for at in range(0, len(whole), CHUNK):
                low, high = block.bounds(whole[at : at + CHUNK].astype(np.float64))
                for r in range(len(low)):
                    a = at + r
                    other = np.flatnonzero((block.labels == labels[a]) & (block.nodes != nodes[a]))
                    other = other[high[r, other] >= kth_largest(low[r, other], k)]
                    scores = block.scores(whole[a], other)
                    best = first(scores, block.ids[other], block.nodes[other], k)
                    for name, x in (("anchor", [nodes[a]] * len(best)), ("anchor_id", [ids[a]] * len(best)), ("id", block.ids[other[best]]), ("node", block.nodes[other[best]]), ("score", scores[best])):
                        out[name].extend(x)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole number s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(books: dict, k: int, least: int, most: int):
    """For each anchor and positive, the k best rows of other labels in the positive's window in a block."""
    names = ("anchor", "positive", "id", "node", "score")

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {n: [] for n in names}
        if rows.num_rows and anchors.num_rows:
            block = Block(rows, books[key[0].as_py()])
            whole = matrix(anchors["v"], np.int64).reshape(anchors.num_rows, -1)
            nodes, labels, wanted = anchors["node"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
            for at in range(0, len(whole), CHUNK):
                low, high = block.bounds(whole[at : at + CHUNK].astype(np.float64))
                for r in range(len(low)):
                    a = at + r
                    other = np.flatnonzero(block.labels != labels[a])
                    lo, hi = low[r, other], high[r, other]
                    possible = []
                    for p in wanted[a]:
                        begin, end = window(p["score"], least, most)
                        inside = kth_largest(lo[(lo >= begin) & (hi <= end)], k)
                        possible.append((hi >= max(begin, inside)) & (lo <= end))
                    asked = np.flatnonzero(np.any(possible, axis=0))
                    exact = np.zeros(len(other), np.int64)
                    exact[asked] = block.scores(whole[a], other[asked])
                    for p, might in zip(wanted[a], possible, strict=True):
                        begin, end = window(p["score"], least, most)
                        mine = np.flatnonzero(might & (exact >= begin) & (exact <= end))
                        mine = mine[first(exact[mine], block.ids[other[mine]], block.nodes[other[mine]], k)]
                        for name, x in zip(names, ([nodes[a]] * len(mine), [p["rank"]] * len(mine), block.ids[other[mine]], block.nodes[other[mine]], exact[mine]), strict=True):
                            out[name].extend(x)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def usable_rows(df: DataFrame, scale: int, id_col: str, label_col: Column, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part, v in whole numbers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(F.lit(scale) * x.cast("double")).cast("double"), F.lit(float(EXACT))), F.lit(-float(EXACT))).cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("id"), label_col.cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.withColumn("v", F.transform("v", held))


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "node")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
    part: int = PART,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on ``id``; label one on df's columns.
    """
    spark = df.sparkSession
    rows = usable_rows(df, scale, id_col, F.col("label") if label is None else label, vector_col)
    rows = saved(rows.withColumns({"node": F.monotonically_increasing_id(), "asks": F.coalesce(is_anchor, F.lit(False)), "length": F.size("v")}), "whole-vectors")
    counts = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("anchors")).collect()  # one a length
    books: dict[int, list[np.ndarray]] = {}
    for r in counts:
        share = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < int(min(1, SAMPLE / r.n) * (1 << 30)) + 1
        sample = rows.where((F.col("length") == r.length) & share).select("v").toArrow()["v"]
        books[r.length] = codebooks(matrix(sample).reshape(len(sample), r.length)) if len(sample) else []
    if not counts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for length, own in books.items():  # a sample by hash may be empty where rows are few
        if not own and length:
            books[length] = [np.zeros((1, s.stop - s.start)) for s in runs_of(length)]
    index = saved(rows.select("id", "node", "label", "length", "asks", "v").mapInArrow(_encode(books), "id long, node long, label long, length int, asks boolean, v array<long>, codes binary, residuals array<double>"), "coded-vectors")

    of_length = lambda n: F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r.length, n(r))]), F.col("length"))
    blocks, parts = of_length(lambda r: -(-r.n // block)), of_length(lambda r: max(1, -(-r.anchors // part)))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    keys = ["length", "block", "part"]
    dealt = index.drop("asks").withColumn("block", own(blocks)).withColumn("part", each(parts)).groupBy(*keys)

    def met(anchors: DataFrame, answer: Callable, schema: str) -> DataFrame:
        asked = anchors.withColumn("part", own(parts)).withColumn("block", each(blocks))
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of their own: both sides come from one table
        return dealt.cogroup(asked.groupBy(*keys)).applyInArrow(answer, schema)

    anchors = index.where("asks").select("id", "node", "label", "length", "v")
    best = ranked(met(anchors, _positives(books, positives), "anchor long, anchor_id long, id long, node long, score long"), ["anchor"], positives)
    best = saved(best, "positives")
    windows = best.groupBy(F.col("anchor").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "score"))).alias("positives"))  # as many as asked for
    found = met(anchors.join(windows, "node"), _negatives(books, negatives, low, high), "anchor long, positive long, id long, node long, score long")
    found = ranked(found, ["anchor", "positive"], negatives).select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = best.select("anchor", F.col("rank").cast("long").alias("positive"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(of, ["anchor", "positive"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
