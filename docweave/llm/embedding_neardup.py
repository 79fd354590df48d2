"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

1. Equal vectors become one class (partial aggregation, so a hot class costs one
   row per task), with a number of its own: ids may repeat.
2. A class is hashed in each of ``tables`` tables: three rounds of random signs
   and a fast Hadamard transform, then the index and sign of the largest
   coordinate, ``width`` times.  Multiprobe adds the buckets reached by the
   cheapest second-best coordinates.
3. Very full buckets lend up to ``POINTS`` of their members as pivots.  A class within
   half the threshold's angle of its nearest pivot belongs to that pivot's core: two
   members of a core lie within the threshold for certain, so their links are
   counted by the core's size and they are never compared.
4. Only (bucket, class) rows are shuffled to find buckets that are shared; the
   vectors follow for those alone.
5. Buckets are compared in blocks (``blocks``), cores apart.  Every pair is verified in
   double precision, counted in the first bucket that it shares, and never listed:
   a block emits at most one row per member.

Null, empty, zero-length or non-finite vectors and rows with a null id link with
nothing (a null id has a null component_id).  Repeated rows are copies of each
other and count as links; rows of one id with different vectors are rows of their
own.  Vectors of different lengths never link: the length is part of a bucket's name.
An empty table gives an empty result; further columns are ignored.

``width`` None takes 3, which gives (2 * 64) ** 3 buckets a table for 64 dimensions,
for up to ten million vectors, and one more for each (2 * d) times as many, with more
tables and probes then (``shape``): a pair at the threshold is missed as rarely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import BLOCK, block_pairs, dealt, grouped, keyed_join, labels, split_sides
from docweave.llm.components import components
from docweave.scratch import saved

TABLES, WIDTH, PROBES, POINTS = 8, 3, 4, 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised fast Walsh-Hadamard transform of the rows (length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def bucket_codes(x: np.ndarray, tables: int = TABLES, width: int = WIDTH, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """(rows, tables * probes) int64 codes, ascending by table; x has unit rows."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d), np.float32)
    padded[:, :dim] = x
    signs = np.random.default_rng([seed, dim]).choice(np.float32([-1, 1]), (tables, width, 3, d))
    at = np.arange(n)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        best, second, loss = [], [], []
        for k in range(width):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, k, r]) / np.float32(np.sqrt(d))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[at, top[:, 0]] < size[at, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            code = 2 * top + (y[at[:, None], top] < 0)
            best.append(code[:, 0])
            second.append(code[:, 1])
            loss.append(size[at, top[:, 0]] - size[at, top[:, 1]])
        best, second, loss = np.stack(best, 1), np.stack(second, 1), np.stack(loss, 1)
        weight = (2 * d) ** np.arange(width)
        home = best @ weight
        moved = home[:, None] + (second - best) * weight
        order = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
        both = np.concatenate([home[:, None], np.take_along_axis(moved, order, 1)], 1)
        if both.shape[1] < probes:  # as many more: the two cheapest swaps at once
            two = home + np.take_along_axis((second - best) * weight, np.argsort(loss, axis=1, kind="stable")[:, :2], 1).sum(1)
            both = np.concatenate([both, two[:, None]], 1)[:, :probes]
        out[:, t] = home[:, None] + t * (2 * d) ** width  # where there are fewer probes than asked for, home again
        out[:, t, : both.shape[1]] = both + t * (2 * d) ** width
    return out.reshape(n, -1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps very large and very small norms finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(tables: int, width: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = np.asarray(vectors.value_lengths())
            for dim in np.unique(lengths).tolist():
                rows = pa.array(np.flatnonzero(lengths == dim))
                codes = bucket_codes(unit(matrix(vectors.take(rows), dim)), tables, width, probes)
                each = codes.shape[1]
                flat = pa.array(codes.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(rows), pa.array(np.full(len(rows), dim, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, each, dtype=np.int32)), flat)],
                    names=["node", "dim", "codes"],
                )

    return run


def pivots(hashed: DataFrame, classes: DataFrame, tables: int, probes: int) -> dict[int, np.ndarray]:
    """By length, unit vectors of members of very full buckets.

    A bucket is very full if it is the first choice of more than ``4 * BLOCK`` classes
    and of more than 1 / (2 P) of all, P the number of shuffle partitions: at most 2 P
    are in each table, whatever the rows, so what is collected is at most
    2 * P * tables * POINTS vectors.
    """
    total = hashed.count()
    spread = 2 * int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = F.array(*[F.element_at("codes", t * probes + 1) for t in range(tables)])
    members = hashed.select("node", "dim", F.explode(homes).alias("code"))
    some = [F.min_by("node", F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in range(POINTS)]
    full = members.groupBy("dim", "code").agg(F.count(F.lit(1)).alias("n"), *some).where(F.col("n") > max(total / spread, 4 * BLOCK))
    chosen = full.select(F.explode(F.array(*[f"p{k}" for k in range(POINTS)])).alias("node")).distinct()
    out: dict[int, list] = {}
    for _, v in sorted(map(tuple, classes.select("node", "embedding").join(F.broadcast(chosen), "node").collect())):
        out.setdefault(len(v), []).append(v)
    return {dim: unit(np.array(v, np.float64)) for dim, v in out.items()}


def _cores(points: dict[int, np.ndarray], threshold: float):
    """The number of the nearest pivot within half the threshold's angle, if there is one."""
    # cos(angle / 2), with room for rounding
    least = np.sqrt((1 + threshold) / 2) + 1e-9
    first = dict(zip(points, np.cumsum([0, *map(len, points.values())]), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = np.asarray(vectors.value_lengths())
            core = np.full(batch.num_rows, -1, np.int64)
            for dim in points:
                rows = np.flatnonzero(lengths == dim)
                for part in np.array_split(rows, len(rows) // 1024 + 1):
                    if len(part):
                        near = unit(matrix(vectors.take(pa.array(part)), dim)) @ points[dim].T
                        core[part] = np.where(near.max(1) >= least, first[dim] + near.argmax(1), -1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(core)], names=["node", "copies", "core"])

    return run


def _compare(threshold: float):
    keys = ["dim", "code", "block_i", "block_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for table in grouped(batches, keys):
            nodes = table["node"].to_numpy()
            left, right = split_sides(table)
            x = unit(matrix(table["embedding"].combine_chunks(), table["dim"][0].as_py()))
            linked = x[left] @ x[right].T >= threshold
            linked &= nodes[left][:, None] != nodes[right][None, :]
            core = table["core"].to_numpy()
            linked &= (core[left][:, None] != core[right][None, :]) | (core[left] < 0)[:, None]  # counted with their core
            if not linked.any():
                continue
            codes = matrix_of_codes(table["codes"].combine_chunks())
            linked_first = linked & ~shared_earlier(codes, table["code"][0].as_py(), left, right)
            copies = table["copies"].to_numpy()
            links = np.zeros(len(nodes), np.int64)
            links[left] += linked_first @ copies[right]
            if table["block_i"][0].as_py() != table["block_j"][0].as_py():
                links[right] += linked_first.T @ copies[left]
            component = labels(nodes, left, right, linked)
            at = np.flatnonzero((links > 0) | (component != nodes))
            found.append((nodes[at], links[at], component[at]))
            held += len(at)
            if held > 20_000:
                yield _rows(found)
                found, held = [], 0
        if found:
            yield _rows(found)

    return run


def matrix_of_codes(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def shared_earlier(codes: np.ndarray, code: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the rows share a bucket with a smaller code, where they were counted."""
    rows, at = np.nonzero(codes < code)
    named, place, times = np.unique(codes[rows, at], return_inverse=True, return_counts=True)
    shared = times > 1  # a code of one row joins nothing
    width = int(shared.sum())
    if not width:
        return np.zeros((len(left), len(right)), bool)
    column = np.cumsum(shared) - 1
    keep = shared[place]
    rows, column = rows[keep], column[place[keep]]
    out = np.zeros((len(left), len(right)), bool)
    for first in range(0, width, 4096):  # bounds the matrix at 2048 rows x 4096 codes
        own = (column >= first) & (column < first + 4096)
        has = np.zeros((len(codes), min(4096, width - first)), np.float32)
        has[rows[own], column[own] - first] = 1
        out |= has[left] @ has[right].T > 0
    return out


def _rows(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["node", "links", "peer"])


def shape(count: int, length: int, tables: int = TABLES, probes: int = PROBES) -> tuple[int, int, int]:
    """(width, tables, probes) for so many vectors: one more hash for each (2 * length) times ten million, with half as many tables and as many probes more, so that recall stays."""
    width = WIDTH
    while count > 1e7 * (2 * length) ** (width - WIDTH):
        width, tables, probes = width + 1, tables * 3 // 2, probes * 2
    return width, tables, probes


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    tables: int = TABLES,
    width: int | None = None,
    probes: int = PROBES,
    block: int = BLOCK,
    cores: bool = True,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of df."""
    value = F.col(vector_col)
    usable = (
        F.col(id_col).isNotNull()
        & (F.size(value) > 0)
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    rows = df.select(
        F.col(id_col).cast("long").alias("_id"),
        F.when(usable, F.transform(value, lambda x: x + F.lit(0.0).cast(kind))).alias("embedding"),  # one zero
    )
    # a row without a vector has no second key, so it matches nothing; its first spreads such rows
    missing = F.col("embedding").isNull()
    h1 = F.when(missing, F.xxhash64(F.lit(2), "_id")).otherwise(F.xxhash64("embedding"))
    rows = rows.withColumns({"h1": h1, "h2": F.when(~missing, F.xxhash64(F.lit(1), F.col("embedding")))})
    merged = rows.where(~missing).groupBy("embedding").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.col("embedding")), "node": F.monotonically_increasing_id()}
    classes = saved(merged.withColumns(named), "vectors")
    if width is None:
        count, length = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        width, tables, probes = shape(count, length or 1, tables, probes)
    hashed = saved(classes.select("node", "embedding").mapInArrow(_hash(tables, width, probes), "node long, dim int, codes array<long>"), "codes")
    points = pivots(hashed, classes, tables, probes) if cores else {}
    core = saved(classes.select("node", "embedding", "copies").mapInArrow(_cores(points, threshold), "node long, copies long, core long"), "cores")
    by_core = saved(core.where("core >= 0").groupBy("core").agg(F.min("node").alias("centre"), F.sum("copies").alias("all")), "core-sizes")

    members = hashed.join(core.select("node", "core"), "node").select("node", "dim", "core", F.explode(F.array_distinct("codes")).alias("code"))
    met = block_pairs(members, ["dim", "code"], F.xxhash64("node"), block, "core")
    full = met.drop("core", "dim").join(classes.select("node", "embedding"), "node").join(core, "node").join(hashed, "node")
    found = dealt(full, ["dim", "code"]).mapInArrow(_compare(threshold), "node long, links long, peer long")
    inside = core.join(F.broadcast(by_core), "core").select("node", (F.col("all") - F.col("copies")).alias("links"), F.col("centre").alias("peer"))  # a row for each pivot at most
    found = saved(found.union(inside), "found")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "peer"))
    by_class = saved(
        classes.drop("embedding")
        .join(sums, "node", "left")
        .join(roots, "node", "left")
        .select("h1", "h2", "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "linked",
    )
    groups = by_class.groupBy("component").agg(F.min("least").alias("root"), F.count(F.lit(1)).alias("classes"))
    by_class = keyed_join(by_class, saved(groups, "groups"), ["component"], "classes").select("h1", "h2", "copies", "n_links", "root")
    out = keyed_join(rows.select("_id", "h1", "h2"), saved(by_class, "linked"), ["h1", "h2"], "copies")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("root", "_id").alias("component_id"),
        F.coalesce(F.coalesce("root", "_id") == F.col("_id"), F.lit(False)).alias("kept"),
    )
