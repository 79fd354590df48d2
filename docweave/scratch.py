"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage here.  The tables are plain Parquet, so
a lost executor costs a re-read and never a recomputation of the job so far.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set a temporary one, in local mode alone."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docweave.scratch", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("docweave.scratch", known)
    return known.rstrip("/")


#: Spark's own setting: a finished write removes the shuffle files that it needed
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What a write shuffles in here is on no disk any more when it is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back with the same schema.

    What the write shuffled is on no disk any more when it is done: the table stands for it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
