"""Reading tables, and SQL over them without temporary views."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

#: rows of a table that one task gets where each row takes much work
ROWS = 10_000
#: rows of one task where rows meet by a key; up to STRAIGHT tasks (Spark's default) a shuffle is written
#: straight to files, while with more each writing task holds its rows, so that many get up to MOST rows first
MEETING, STRAIGHT, MOST = 100_000, 200, 2_000_000
TABLE = re.compile(r"(?<!\{)\{([a-z]+)\}(?!\})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, its rows dealt over as many tasks as they need.

    Files are cut by their bytes, and a small one with much work for each row would be one task's.
    """
    rows = table(spark, sf_dir, name)
    return rows.repartition(max(1, math.ceil(rows.count() / ROWS)))  # a count reads the files' footers alone


def met(**keyed: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """The tables, each dealt by its key over as many tasks as the largest needs.

    The number is set by the rows, so no task gets more than MOST, and a join or a grouping by
    that key deals nothing again.
    """
    rows = max(df.count() for df, _ in keyed.values())
    few = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) for df, _ in keyed.values())
    tasks = max(1, min(STRAIGHT, math.ceil(rows / MEETING)), math.ceil(rows / MOST), min(few, math.ceil(rows / ROWS)))
    return {n: df.repartition(tasks, key) for n, (df, key) in keyed.items()}


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """Runs sql with each {name} as that table, or as the one that is given for it."""
    return spark.sql(sql, **{n: given[n] if n in given else table(spark, sf_dir, n) for n in set(TABLE.findall(sql))})


def plain(sql: str) -> str:
    """sql with each {name} as the bare name, for an engine that has the tables as views."""
    return TABLE.sub(r"\1", sql)
