"""Row numbers over a whole table without one task that holds it.

Rows are dealt out by ranges of the order and sorted within each; a row's number is its place
in its range plus the sizes of the ranges before, of which there are as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.scratch import saved


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """df with its rows' numbers, from 0.  Rows that are equal in ``order`` come in any order."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = saved(placed, "numbered")  # a range's bounds come from a sample: here they are fixed
    part = F.shiftright("_place", 33)  # of such an id the upper bits number the partition, the lower ones its rows
    before, ahead = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row a partition
        ahead += [F.lit(r.part), F.lit(before)]
        before += r.n
    if not ahead:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("_place")
    offset = F.element_at(F.create_map(*ahead), part)
    return placed.withColumn(name, (offset + F.col("_place").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_place")
