"""Mergeable sketches: quantiles and distinct counts by hour, stored once and merged for any range.

``store`` writes one row for each hour and group: a KLL sketch of a value, an HLL sketch of an
id and a count, partitioned by day.  ``between`` reads the days of a range alone and merges
its rows; the events are not read again, and no group's values are held anywhere.

Sketches have a fixed size: with ``K`` 800 a quantile's rank is off by well under 1 % (about
0.3 % for 99 of 100 answers), with ``LG`` 14 a distinct count by about 1 %.  Null values and ids
are not counted in their sketches, though their rows are in n; an empty range gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.scratch import shared_dir
from docweave.tables import table

K, LG = 800, 14
QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def hourly(events: DataFrame, group: str, value: str, who: str, at: str = "ts") -> DataFrame:
    """(day, hour, group, n, values, whom): aggregated before the shuffle, so a busy group is a row a task."""
    keys = [F.to_date(at).alias("day"), F.date_trunc("hour", F.col(at).cast("timestamp")).alias("hour"), F.col(group).alias("group")]
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("values"), F.hll_sketch_agg(F.col(who), F.lit(LG)).alias("whom")
    )


def store(path: str, events: DataFrame, group: str, value: str, who: str, at: str = "ts") -> None:
    """Appends the sketches of events; hours of later events may repeat, as rows merge."""
    hourly(events, group, value, who, at).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def between(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """(group, n, values, whom) of the hours from ``first`` to before ``last`` (timestamps as text)."""
    rows = spark.read.schema("hour timestamp, `group` string, n long, values binary, whom binary, day date").parquet(path)
    a, b = F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")
    days = (F.col("day") >= F.to_date(a)) & (F.col("day") <= F.to_date(b))  # a partition filter
    held = rows.where(days & (F.col("hour") >= a) & (F.col("hour") < b))
    return held.groupBy("group").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values", F.lit(K)).alias("values"), F.hll_union_agg("whom").alias("whom"))


def quantile(values: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(q))


_stored: dict[tuple, str] = {}


def events_sketches(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
        store(path, table(spark, sf_dir, "events"), "event_type", "value", "user_id")
        _stored[key] = path
    return _stored[key]


def q_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of 30 days from the stored hours, each with whether its rank in the events is within 1 %."""
    merged = between(spark, events_sketches(spark, sf_dir), "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    asked = merged.select("group", "n", "whom", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), quantile(F.col("values"), q).alias("value")) for q in QUANTILES])).alias("a"))
    asked = asked.select("group", "n", F.hll_sketch_estimate("whom").alias("users"), "a.q", F.col("a.value").alias("estimate"))
    events = table(spark, sf_dir, "events").where("ts < TIMESTAMP '2024-01-31 00:00:00'").select("event_type", "value", "user_id")
    met = events.join(F.broadcast(asked), events.event_type == asked.group)  # a row for each group and quantile
    true = met.groupBy("event_type", "q").agg(
        F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("below"),
        F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("up_to"),
        F.count_distinct("user_id").alias("true_users"),
        F.max("users").alias("users"),
        F.max("n").alias("n"),
    )
    near = (F.col("below") <= F.col("q") + 0.01) & (F.col("up_to") >= F.col("q") - 0.01)
    close = F.abs(F.col("users") - F.col("true_users")) <= F.greatest(F.lit(1.0), 0.03 * F.col("true_users"))
    return true.select("event_type", "q", "n", near.alias("rank_within_one_percent"), close.alias("users_within_three_percent"))


SQL = f"""
SELECT event_type, q, count(*) AS n, true AS rank_within_one_percent, true AS users_within_three_percent FROM events CROSS JOIN (SELECT unnest([{", ".join(f"{q}e0" for q in QUANTILES)}]) AS q) x
WHERE ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY event_type, q"""


def q_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored hours hold, by day."""
    rows = spark.read.schema("hour timestamp, `group` string, n long, values binary, whom binary, day date").parquet(events_sketches(spark, sf_dir))
    ends = F.kll_sketch_get_n_double("values")
    return rows.groupBy("day", "group").agg(F.count_distinct("hour").alias("hours"), F.sum("n").alias("n"), F.sum(ends).cast("long").alias("n_values")).withColumnRenamed("group", "event_type")


HOURLY_SQL = """
SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT date_trunc('hour', ts)) AS hours, count(*) AS n, count(value) AS n_values FROM events GROUP BY CAST(ts AS DATE), event_type"""

QUERIES = {"sketch_quantiles": q_range, "sketch_hours": q_hourly}
ORACLES = {"sketch_quantiles": SQL, "sketch_hours": HOURLY_SQL}
