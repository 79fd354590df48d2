"""Connected components of a link table by alternating large and small stars.

Each round re-points the neighbours of a node at its smallest neighbour; the
number of rounds grows with the logarithm of the longest chain.  Only joins and
grouped minima on the links are used: no group is collected, hubs of a large share
of the links get their minimum by broadcast (``blocks.keyed_join``), and each round
ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import keyed_join
from docweave.scratch import saved


def _both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(e: DataFrame, large: bool, total: int) -> DataFrame:
    """Large: larger neighbours of u go to its smallest; small: u and its smaller ones do."""
    near = _both_ways(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    hop = keyed_join(near, least, ["u"], "n", "inner", total=2 * total if large else total)
    if large:
        hop = hop.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hop = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hop.where("u <> v").distinct()


def _digest(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for nodes that have a link.

    links has two long columns; self links and repeats are ignored.
    """
    u, v = links.columns
    edges = saved(
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(),
        "links",
    )
    before = _digest(edges)
    while before[0]:
        edges = saved(_star(_star(edges, True, before[0]), False, before[0]), "links")
        now = _digest(edges)
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.union(roots)
