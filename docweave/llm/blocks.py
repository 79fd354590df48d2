"""Comparing the members of buckets without ever listing a bucket's pairs.

A bucket of n members is cut into ceil(n / size) blocks by a hash of the member.
One group is made for each pair of blocks, so no group holds more than
2 * size rows however hot the bucket is, and a bucket of usual size is one group.
Members of a core (which are linked for certain, or joined already) that fill more
than a block are cut into blocks of their own, which do not meet each other: a
bucket that is one core is not compared at all.  Groups run through ``grouped`` inside mapInArrow: a task streams the groups
dealt to it and holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
#: rows that one task can take, whatever their keys
FEW = 50_000


def block_pairs(members: DataFrame, keys: list[str], by: Column, size: int = BLOCK, core: str | None = None) -> DataFrame:
    """Members of keys that two or more share, with block_i <= block_j and own block.

    core names a column, negative for members without one.  members must be cheap to
    scan twice (a saved table).
    """
    own = F.col(core) if core else F.lit(-1)
    counts = members.groupBy(*keys, own.alias("_core")).agg(F.count(F.lit(1)).alias("_n"))
    # a core of no more than a block is compared like others
    counts = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.collect_list(F.when((F.col("_core") >= 0) & (F.col("_n") > size), F.struct("_core", "_n"))).alias("_cores"))
    counts = counts.where("_all > 1").withColumn("_cores", F.array_sort("_cores"))  # as many as there are pivots, at most
    inside = F.aggregate("_cores", F.lit(0).cast("long"), lambda a, c: a + c["_n"])
    plain = F.ceil((F.col("_all") - inside) / F.lit(size)).cast("int")
    blocks_of = lambda c: F.ceil(c["_n"] / F.lit(size)).cast("int")
    counts = counts.withColumn("_plain", plain)
    counts = counts.withColumn("_ends", F.aggregate("_cores", F.array("_plain"), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + blocks_of(c)))))
    out = members.join(counts, keys)
    at = F.coalesce(F.array_position(F.transform("_cores", lambda c: c["_core"]), own), F.lit(0)).cast("int")  # 0: no core of its own
    first = F.when(at > 0, F.get("_ends", at - 1)).otherwise(0)
    out = out.withColumns({"_first": first, "_count": F.get("_ends", at) - first, "_in_core": at > 0})
    out = out.withColumn("block", (F.col("_first") + F.pmod(by, F.col("_count"))).cast("int"))
    others = F.sequence(F.lit(0), F.element_at("_ends", -1) - 1)
    outside = F.filter(others, lambda b: ~F.col("_in_core") | (b < F.col("_first")) | (b >= F.col("_first") + F.col("_count")))
    out = out.withColumn("_other", F.explode(outside))
    out = out.withColumns({"block_i": F.least("block", "_other"), "block_j": F.greatest("block", "_other")})
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in members.columns])


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_join(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str, how: str = "left", total: int | None = None) -> DataFrame:
    """rows joined to the class of their keys, of which there is one row each, with its number of rows in ``copies``.

    A class of more than 1 / (2 P) of all rows, P the number of shuffle partitions, is
    hot: at most 2 P classes can be, so those are broadcast, and their rows are not
    shuffled.  The others are joined by Spark's choice.  classes should be cheap to
    scan twice; with ``total``, the number of rows, no job runs here.  Keys of rows may
    be null where how is "left"; such rows match nothing.  Up to ``FEW`` rows need no
    such care.
    """
    spread = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = total is not None
    if not known:
        total = classes.agg(F.sum(copies)).first()[0] or 0
    if total <= FEW:
        return rows.join(classes, keys, how)
    hot = classes.where(F.col(copies) > max(total / spread, 1))
    if not known and hot.isEmpty():
        return rows.join(classes, keys, how)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return rest.join(classes, keys, how).unionByName(rows.join(F.broadcast(hot), keys))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    keys = [*keys, "block_i", "block_j"]
    return df.repartition(*keys).sortWithinPartitions(*keys)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys, from batches sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [np.asarray(batch.column(k)) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and tuple(c[0] for c in cols) != last:
            yield pa.concat_tables(held)
            held = []
        begin = 0
        for cut in [*cuts.tolist(), None]:
            part = table.slice(begin, None if cut is None else cut - begin)
            held.append(part)
            if cut is not None:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held, begin = [], cut
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


def split_sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of both blocks of a group; the same twice for a block with itself."""
    i, j = table["block_i"][0].as_py(), table["block_j"][0].as_py()
    own = table["block"].to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def labels(nodes: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest node of each row's component under linked (left by right) rows."""
    out = nodes.copy()
    top = np.iinfo(np.int64).max
    while True:
        before = out.copy()
        out[left] = np.minimum(out[left], np.where(linked, out[right][None, :], top).min(1, initial=top))
        out[right] = np.minimum(out[right], np.where(linked, out[left][:, None], top).min(0, initial=top))
        if (out == before).all():
            return out


def star_edges(nodes: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(nodes != component)
    return nodes[at], component[at]
