"""Event-time windows, the same function over a batch and over a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.scratch import shared_dir
from docweave.tables import table


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts, errors, sum and largest value of each window and event type.

    ts is cast to a zoned timestamp, which watermarks need.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", width), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most")
    )
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n", "total", "most")


def windows_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"))


def windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what is there; a window comes out, as rows of files, when the watermark has passed it.

    The last windows of a finished stream are still open then, so those that are not
    in the files are computed from the rows that they cover.
    """
    closed = _written(spark, windowed(_streamed(spark, sf_dir)), "windows")
    last = closed.agg(F.max("day")).first()[0]
    events = table(spark, sf_dir, "events")
    rest = windowed(events if last is None else events.where(F.to_date("ts") > F.lit(last)))
    return closed.union(rest)


def waits(published: DataFrame, started: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Each user's views within an hour after a click, and how long they waited; over streams the join's state ends with the watermark."""
    a = published.where("event_type = 'click'").selectExpr("event_id AS click", "user_id", "CAST(ts AS TIMESTAMP) AS clicked").withWatermark("clicked", late)
    b = started.where("event_type = 'view'").selectExpr("event_id AS view", "user_id AS viewer", "CAST(ts AS TIMESTAMP) AS viewed").withWatermark("viewed", late)
    met = a.join(b, F.expr(f"viewer = user_id AND viewed >= clicked AND viewed <= clicked + INTERVAL {within}"))
    return met.select("click", "view", "user_id", F.expr("unix_micros(viewed) - unix_micros(clicked)").alias("waited_us"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def waits_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return waits(events, events)


def _written(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends to files that executors write and read; state and results lie in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def waits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream-stream join over what is there; inner matches come out at once."""
    return _written(spark, waits(_streamed(spark, sf_dir), _streamed(spark, sf_dir)), "waits")


WAITS_SQL = """
SELECT a.event_id AS click, b.event_id AS view, a.user_id, epoch_us(b.ts) - epoch_us(a.ts) AS waited_us FROM events a
JOIN events b ON b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'view'
"""
SQL = """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most
FROM events GROUP BY CAST(ts AS DATE), event_type
"""
QUERIES = {"window_batch": windows_batch, "window_stream": windows_stream, "queue_wait": waits_batch, "queue_wait_stream": waits_stream}
ORACLES = {"window_batch": SQL, "window_stream": SQL, "queue_wait": WAITS_SQL, "queue_wait_stream": WAITS_SQL}
