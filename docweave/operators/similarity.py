"""Similarity join of names by sets of trigrams, with prefix, length and overlap filters.

Names are padded with two blanks ahead and one behind, lower-cased and cut into the set of
their trigrams.  Two names are similar if their sets' resemblance exceeds a threshold.

1. Equal names are one row; a name's trigrams are put in order of their rarity.
2. A pair above the threshold t shares one of the |x| - floor(t |x|) rarest trigrams of
   each side, so those alone (the prefix) are joined.  The most frequent trigrams are
   in no prefix, unless a name has no others.
3. Partners' sizes lie between t |x| and |x| / t; and behind the places of the shared
   trigram there must be enough trigrams left for the overlap that t needs.
4. What remains is verified on the whole sets.

Names that share most of their trigrams, such as urls, pass these filters nearly all, once for each
shared trigram.  ``similar_in_blocks`` compares them block by block.  For a pair of blocks trigrams
of many names are a product of two matrices of 0 and 1, and those of few are counted name by name;
only pairs above the threshold leave it.  Blocks travel in sides of several, so that a name is
sent once for each side that its own one meets, and found pairs leave a task block by block.

Nulls match nothing; a name of fewer characters than a trigram has the padding's trigrams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.shipping import ship
from docweave.tables import table

#: names of a block, and trigrams of one product of matrices
BLOCK, COLUMNS = 1024, 4096
#: blocks of a side at most, and sides at least where there are as many blocks
SIDE, SIDES = 8, 24
#: found pairs that leave a task at once
ROWS = 1 << 16
#: a trigram with more pairs of names than these in a pair of blocks is a column of the matrices
FEW = 2048


def trigrams(name: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def _ordered(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, grams): each name's trigrams, rarest first."""
    each = names.select("name", F.explode("grams").alias("gram")).join(counts, "gram")
    entry = F.array_sort(F.collect_list(F.struct("n", "gram")))  # of one name
    return each.groupBy("name").agg(F.transform(entry, lambda e: e["gram"]).alias("grams"))


def _prefixes(names: DataFrame, threshold: float, side: str) -> DataFrame:
    size = F.size("grams")
    prefix = F.slice("grams", 1, F.greatest(F.lit(1), size - F.floor(F.lit(threshold) * size - 1e-9).cast("int")))
    return names.select(F.col("name").alias(side), F.col("grams").alias(f"{side}_grams"), F.posexplode(prefix).alias(f"{side}_at", "gram"))


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, l_grams, r_grams): distinct pairs that pass the filters; left and right are (name, grams), rarest first."""
    met = _prefixes(left, threshold, "l").join(_prefixes(right, threshold, "r"), "gram")
    a, b = F.size("l_grams"), F.size("r_grams")
    need = F.floor(F.lit(threshold / (1 + threshold)) * (a + b) - 1e-9) + 1  # the overlap is larger than t / (1 + t) of both sizes
    # trigrams ahead of the shared one can be shared, those behind it can, and itself
    may = F.least("l_at", "r_at") + 1 + F.least(a - F.col("l_at"), b - F.col("r_at")) - 1
    fits = (a > F.lit(threshold) * b) & (b > F.lit(threshold) * a) & (may >= need)
    return met.where(fits).groupBy("l", "r").agg(F.first("l_grams").alias("l_grams"), F.first("r_grams").alias("r_grams"))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """(name, grams) of the different names without regard to case."""
    return df.where(F.col(column).isNotNull()).select(F.lower(column).alias("name")).distinct().withColumn("grams", trigrams(F.col("name")))


def similar(left: DataFrame, right: DataFrame, threshold: float = 0.25, digits: int = 6) -> DataFrame:
    """(l, r, similarity) of all pairs of lower-cased names above the threshold; left and right come from ``distinct_names``."""
    counts = left.select(F.explode("grams").alias("gram")).unionAll(right.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    pairs = candidates(_ordered(left, counts), _ordered(right, counts), threshold)
    both, either = F.size(F.array_intersect("l_grams", "r_grams")), F.size(F.array_union("l_grams", "r_grams"))
    share = both.cast("double") / either
    return pairs.where(share > threshold).select("l", "r", F.round(share, digits).alias("similarity"))


def _sets(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(name's place, trigram as a number) of each name's set."""
    padded = [f"  {n} " for n in names]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.int64)
    own = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    whole = own[:-2] == own[2:]
    order = np.lexsort((grams[whole], own[:-2][whole]))
    own, grams = own[:-2][whole][order], grams[whole][order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    return own[first], grams[first]


class _Block:
    """Names and their sets; the trigrams are numbered over all blocks of a task."""

    def __init__(self, places: np.ndarray, own: np.ndarray, grams: np.ndarray, kinds: int):
        self.places, self.sizes = places, np.bincount(own, minlength=len(places))
        order = np.argsort(grams, kind="stable")
        self.own, self.grams = own[order], grams[order]
        self.counts = np.bincount(grams, minlength=kinds)
        self.begins = np.cumsum(self.counts) - self.counts


def _blocks(names: list[str], block: np.ndarray) -> dict[int, _Block]:
    own, grams = _sets(names)
    kinds, grams = np.unique(grams, return_inverse=True)
    order = np.argsort(block, kind="stable")
    numbers, begins = np.unique(block[order], return_index=True)
    within = np.empty(len(block), np.int64)
    within[order] = np.arange(len(block)) - np.repeat(begins, np.diff(np.append(begins, len(block))))
    out = {}
    for n, places in zip(numbers.tolist(), np.split(order, begins[1:]), strict=True):
        here = block[own] == n
        out[n] = _Block(places, within[own[here]], grams[here], len(kinds))
    return out


def _overlaps(left: _Block, right: _Block) -> np.ndarray:
    """How many trigrams each left name shares with each right one."""
    both, pairs = None, left.counts * right.counts
    # of many names: columns of two matrices
    many = np.flatnonzero(pairs > FEW)
    column = np.full(len(pairs), -1)
    column[many] = np.arange(len(many))
    for begin in range(0, max(1, len(many)), COLUMNS):
        wide = min(COLUMNS, len(many) - begin)
        m, n = np.zeros((len(left.places), wide), np.float32), np.zeros((len(right.places), wide), np.float32)
        for cells, side in ((m, left), (n, right)):
            c = column[side.grams] - begin
            here = np.flatnonzero((c >= 0) & (c < wide))
            cells[side.own[here], c[here]] = 1
        both = m @ n.T if both is None else both + m @ n.T
    # of few names: each left name with a trigram meets the right names with it
    few = np.flatnonzero(((pairs > 0) & (pairs <= FEW))[left.grams])
    own, grams = left.own[few], left.grams[few]
    times = right.counts[grams]
    at = np.repeat(right.begins[grams] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    np.add.at(both.reshape(-1), np.repeat(own, times) * both.shape[1] + right.own[at], np.float32(1))
    return both


def _found(left: _Block, right: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which left names and right names are above the threshold, and their resemblance; a block with itself gives each pair once."""
    both = _overlaps(left, right)
    # the overlap is larger than t / (1 + t) of both sizes; what may be is then decided in doubles
    a, b = (threshold / (1 + threshold) * x.sizes for x in (left, right))
    cells = np.flatnonzero(both > (a[:, None] - 0.01).astype(np.float32) + b.astype(np.float32))
    x, y = np.divmod(cells, both.shape[1])
    shared = both.reshape(-1)[cells].astype(np.float64)
    share = shared / (left.sizes[x] + right.sizes[y] - shared)
    kept = (share > threshold) & ((x < y) if left is right else True)
    return x[kept], y[kept], share[kept]


def _compared(threshold: float, side: int, digits: int) -> Callable[[tuple[pa.Scalar, ...], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key)
        rows = pa.Table.from_batches(batches).combine_chunks()
        name = rows["name"].combine_chunks()
        names, block = name.to_pylist(), rows["block"].to_numpy()
        blocks = _blocks(names, block)
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        for n, left in blocks.items():
            for m, right in blocks.items():
                if n // side != i or m // side != j or n > m:
                    continue
                x, y, share = _found(left, right, threshold)
                # a pair is two places among the names of both blocks, which are sent once
                places = left.places if n == m else np.concatenate([left.places, right.places])
                y += len(places) - len(right.places)
                order = rank[places]
                x, y = np.where(order[x] < order[y], (x, y), (y, x)).astype(np.int32)
                share = np.floor(share * 10**digits + 0.5) / 10**digits  # half up, as Spark's round
                for at in range(0, len(x), ROWS):
                    own = slice(at, at + ROWS)
                    pairs = pa.StructArray.from_arrays([pa.array(x[own]), pa.array(y[own]), pa.array(share[own])], names=["l", "r", "similarity"])
                    columns = (name.take(pa.array(places)), pairs)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["names", "pairs"])

    return run


def similar_in_blocks(names: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """(l, r, similarity) of all pairs l < r of different lower-cased names above the threshold; names come from ``distinct_names``."""
    n = max(1, -(-names.count() // BLOCK))
    side = max(1, min(SIDE, n // SIDES))
    sides = -(-n // side)
    block = F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    own = F.floor(F.col("block") / side).cast("int")
    dealt = names.select("name", block.alias("block")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    pairs = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "name", "block")
    pairs = pairs.repartition(min(sides * (sides + 1) // 2, 4096), "i", "j")
    met = pairs.groupBy("i", "j").applyInArrow(_compared(threshold, side, digits), "names array<string>, pairs array<struct<l: int, r: int, similarity: double>>")
    return met.select("names", F.inline("pairs")).select(F.get("names", "l").alias("l"), F.get("names", "r").alias("r"), "similarity")


def resolved(wanted: DataFrame, known: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(wanted_id, id, similarity): the best known name of each wanted one.

    wanted is (wanted_id, wanted), known (id, name).  An equal name counts 2, one equal without
    case 1.5, others their resemblance.  Each name is ranked once; of its rows the one
    with the smallest id stands for it.
    """
    spelt = known.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"))
    folded = spelt.groupBy(F.lower("name").alias("r")).agg(F.min("id").alias("id"))
    pairs = similar(distinct_names(wanted, "wanted"), distinct_names(known, "name"), threshold)
    pairs = pairs.join(folded, "r").withColumn("similarity", F.when(F.col("l") == F.col("r"), F.lit(1.5)).otherwise(F.col("similarity")))
    best = Window.partitionBy("l").orderBy(F.desc("similarity"), "id")
    top = pairs.withColumn("_at", F.row_number().over(best)).where("_at = 1").select("l", "id", "similarity")
    asked = wanted.where("wanted IS NOT NULL")
    exact = spelt.select(F.col("name").alias("wanted"), F.col("id").alias("exact_id"))
    out = asked.join(exact, "wanted", "left").join(top, F.lower("wanted") == F.col("l"), "left")
    out = out.select("wanted_id", F.coalesce("exact_id", "id").alias("id"), F.when(F.col("exact_id").isNotNull(), F.lit(2.0)).otherwise(F.col("similarity")).alias("similarity"))
    return out.where("id IS NOT NULL")


def _wanted(part: DataFrame) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.replace("p_name", F.lit("e"), F.lit("a")))
    return part.select(F.col("p_partkey").alias("wanted_id"), name.alias("wanted"))


def q_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name, as it is, in capitals or misspelt, against all parts' names."""
    part = table(spark, sf_dir, "part")
    return resolved(_wanted(part), part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("wanted_id", F.col("id").alias("p_partkey"), "similarity")


_SQL_GRAMS = "list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3)))"
RESOLVED_SQL = f"""
WITH w AS (SELECT p_partkey AS wanted_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE replace(p_name, 'e', 'a') END AS wanted FROM part),
a AS (SELECT wanted, '  ' || lower(wanted) || ' ' AS n, {_SQL_GRAMS} AS g FROM (SELECT DISTINCT wanted FROM w) x),
b AS (SELECT p_name, id, '  ' || lower(p_name) || ' ' AS n, {_SQL_GRAMS} AS g FROM (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name) x),
s AS (SELECT wanted, id, CASE WHEN p_name = wanted THEN 2e0 WHEN a.n = b.n THEN 1.5e0 ELSE round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) END AS similarity,
  len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS share FROM a, b)
SELECT wanted_id, id AS p_partkey, similarity FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY similarity DESC, id) AS pos FROM s WHERE share > 0.25e0) r JOIN w USING (wanted) WHERE pos = 1"""

URL_THRESHOLD = 0.6


def q_similar_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls that resemble each other by more than 0.6, each pair once."""
    ship(spark)
    names = distinct_names(table(spark, sf_dir, "pages"), "url")
    return similar_in_blocks(names, URL_THRESHOLD).select(F.col("l").alias("url"), F.col("r").alias("other"), "similarity")


URLS_SQL = f"""
WITH a AS (SELECT url, '  ' || url || ' ' AS n, {_SQL_GRAMS} AS g FROM (SELECT DISTINCT lower(url) AS url FROM pages WHERE url IS NOT NULL) x)
SELECT a.url, b.url AS other, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM a JOIN a b ON a.url < b.url
WHERE len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) > {URL_THRESHOLD}e0"""

QUERIES = {"resolve_product": q_resolved, "similar_urls": q_similar_urls}
ORACLES = {"resolve_product": RESOLVED_SQL, "similar_urls": URLS_SQL}


def least_overlap(a: int, b: int, threshold: float) -> int:
    """Trigrams that sets of these sizes share at least, if they resemble each other by more than the threshold."""
    return math.floor(threshold / (1 + threshold) * (a + b)) + 1
